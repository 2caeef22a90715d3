"""Queries over stored results: summaries, checks, status, naming; each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from imgtrace.functions import naming
from imgtrace.functions import temporal
from imgtrace.operators import classifier, frames, images, movies, neuropil
from imgtrace.plans import jobs
from imgtrace.plans.catalogue import brightest, brightest_sql, MASKS, MOVIE, OFFSETS, RANKED, monthly_prices, movie, offsets, query, ranked_events, read, rounded, supplier_masks


# ---- movies

@query(f"""with {MOVIE}, {OFFSETS}, moved as (select frame, round(y)::bigint as dy, round(x)::bigint as dx from offsets)
select m.frame, (((pixel // 8 - dy) % 8 + 8) % 8) * 8 + ((pixel % 8 - dx) % 8 + 8) % 8 as pixel, round(value, 5) + 0.0 as value from movie m join moved o on o.frame = m.frame""")
def frame_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifts = offsets(spark, sf_dir).select("frame", F.round("y").cast("long").alias("dy"), F.round("x").cast("long").alias("dx"))
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), "embedding").join(shifts, "frame")
    out = frames.per_frame(rows, "embedding", 8, 8, lambda x, o: frames.translated(x, o["dy"], o["dx"]), ["frame", "dy", "dx"])
    return rounded(frames.as_pixels(out, "frame"), "value", digits=5)


@query(f"""with {MOVIE} select m.frame, m.pixel, round(case when m.pixel // 8 % 2 = 0 then m.value else coalesce(s.value, 0) end, 5) + 0.0 as value
from movie m left join movie s on s.frame = m.frame and s.pixel = m.pixel - 2 and m.pixel % 8 >= 2""")
def frame_bidirectional_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = frames.per_frame(read(spark, sf_dir, "embeddings"), "embedding", 8, 8, lambda x, _: frames.odd_rows_shifted(x, 2), ["vec_id"])
    return rounded(frames.as_pixels(out.withColumnRenamed("vec_id", "frame"), "frame"), "value", digits=5)


@query(f"""with {RANKED}, counted as (select *, count(*) over (partition by user_id) as n from ranked), k as (select k, exp(-k * k / 8.0) / (select sum(exp(-q * q / 8.0)) from (select unnest(range(-3, 4)) as q)) as w from (select unnest(range(-3, 4)) as k)),
wanted as (select user_id, frame, w, n, ((frame + k) % (2 * n) + 2 * n) % (2 * n) as pos from counted, k)
select x.user_id, x.frame, round(sum(w * value), 6) + 0.0 as smooth from wanted x join ranked r on r.user_id = x.user_id and r.frame = case when pos < x.n then pos else 2 * x.n - 1 - pos end group by x.user_id, x.frame""")
def trace_gaussian_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = movies.weighted_in_time(ranked_events(spark, sf_dir), "user_id", "frame", "value", 2.0, 3)
    return rounded(out.select("user_id", "frame", "smooth"), "smooth", digits=6)


TWO = """two as (select pixel, avg(case when label < 5 then value end) as first, avg(case when label >= 5 then value end) as second from movie group by pixel),
placed as (select *, pixel // 8 * 2 // 8 as by_, pixel % 8 * 2 // 8 as bx from two)"""


def two_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = movie(spark, sf_dir, "label")
    return m.groupBy("pixel").agg(F.avg(F.when(F.col("label") < 5, F.col("value"))).alias("first"), F.avg(F.when(F.col("label") >= 5, F.col("value"))).alias("second"))


@query(f"""with {MOVIE}, {TWO}, slopes as (select by_, bx, sum(first * second) / sum(first * first) as slope from placed group by all)
select pixel, round(greatest(0, second - slope * first), 5) + 0.0 as value from placed p join slopes s on s.by_ = p.by_ and s.bx = p.bx""")
def image_bleedthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = movies.bleedthrough_corrected(two_images(spark, sf_dir), 8, 8, 2)
    return rounded(out.select(F.col("pixel").cast("long").alias("pixel"), "value"), "value", digits=5)


@query(f"""with {MOVIE}, field as (select frame, pixel, pixel // 8 + value * 0.5 as sy, pixel % 8 - value * 0.5 as sx from movie),
corners as (select frame, pixel, trunc(sy) + a as y, trunc(sx) + b as x, (case a when 1 then sy - trunc(sy) else 1 - (sy - trunc(sy)) end) * (case b when 1 then sx - trunc(sx) else 1 - (sx - trunc(sx)) end) as w from field, (values (0), (1)) p(a), (values (0), (1)) q(b)),
wanted as (select frame, pixel, (least(greatest(y, 0), 7) * 8 + least(greatest(x, 0), 7))::bigint as source, w from corners)
select w.frame as key, w.pixel, round(sum(w * value), 5) + 0.0 as value from wanted w join movie m on m.frame = w.frame and m.pixel = w.source group by all""")
def image_warp(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = lambda sign: F.transform("embedding", lambda v: v.cast("double") * sign * 0.5)
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), "embedding", half(1).alias("dy"), half(-1).alias("dx"))
    out = frames.per_frame(rows, "embedding", 8, 8, lambda x, o: frames.warped(x, o["dy"].reshape(x.shape), o["dx"].reshape(x.shape)), ["key", "dy", "dx"])
    return rounded(frames.as_pixels(out, "key"), "value", digits=5)


@query(f"""with {MOVIE}, scores as (select pixel as component, frame, value as score from movie where pixel < 3),
ranked as (select *, row_number() over (partition by component order by score, frame) as low, row_number() over (partition by component order by score desc, frame) as high from scores),
chosen as (select component, frame, 'low' as "end" from ranked where low <= 30 union all select component, frame, 'high' from ranked where high <= 30)
select component, "end", pixel, round(avg(value), 5) + 0.0 as value from movie m join chosen c on c.frame = m.frame group by all""")
def image_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = movie(spark, sf_dir)
    scores = m.where("pixel < 3").select(F.col("pixel").cast("long").alias("component"), "frame", F.col("value").alias("score"))
    out = movies.extreme_means(m, scores, 30)
    return rounded(out.select("component", "end", F.col("pixel").cast("long").alias("pixel"), "value"), "value", digits=5)


@query(f"""with {MOVIE}, planes as (select label as plane, pixel, value, dense_rank() over (partition by label order by frame) - 1 as frame from movie),
n as (select min(last) as last from (select max(frame) as last from planes group by plane)),
places as (select label as plane, (row_number() over (order by label) - 1) // 4 * 8 as oy, (row_number() over (order by label) - 1) % 4 * 8 as ox from (select distinct label from embeddings)),
placed as (select frame, (pixel // 8 + oy) * 32 + pixel % 8 + ox as pixel, value from planes p join places a on a.plane = p.plane where frame <= (select last from n)),
canvas as (select frame, pixel from (select distinct frame from placed), (select unnest(range(24 * 32)) as pixel))
select c.frame, c.pixel, round(coalesce(value, 0), 5) + 0.0 as value from canvas c left join placed p on p.frame = c.frame and p.pixel = c.pixel""")
def movie_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    planes = temporal.numbered(rows, "label", "vec_id").select(F.col("label").alias("plane"), "frame", F.col("embedding").alias("pixels"))
    at = images.mosaic_offsets(rows, "label", 8, 8).withColumnRenamed("label", "plane")
    return rounded(frames.as_pixels(movies.combined(planes, at, 8, 8, 24, 32), "frame"), "value", digits=5)


# ---- surrounds and classification

RINGS = f"""marks as {brightest_sql(0.98)},
box as (select roi, greatest(min(pixel // 100) - 1, 0) as y0, least(max(pixel // 100) + 1, 999) as y1, greatest(min(pixel % 100) - 1, 0) as x0, least(max(pixel % 100) + 1, 99) as x1 from marks group by roi),
rows_ as (select roi, x0, x1, unnest(range(y0, y1 + 1)) as y from box), around as (select roi, y * 100 + x as pixel from (select roi, y, unnest(range(x0, x1 + 1)) as x from rows_)),
border as (select distinct roi, y * 100 + x as pixel from (select roi, pixel // 100 + dy as y, pixel % 100 + dx as x from marks, (values (0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)) s(dy, dx)) where y between 0 and 999 and x between 0 and 99),
surround as (select a.roi, a.pixel from around a where a.pixel not in (select pixel from marks) and not exists (select 1 from border b where b.roi = a.roi and b.pixel = a.pixel))"""


def bright_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brightest(spark, sf_dir, 0.98).select("roi", "pixel")


@query(f"with {RINGS} select roi, count(*) as pixels, sum(pixel)::bigint as total from surround group by roi")
def mask_surrounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = neuropil.surrounds(bright_masks(spark, sf_dir), "roi", "pixel", 100, 1000, 1, 1)
    return out.groupBy("roi").agg(F.count("*").alias("pixels"), F.sum("pixel").alias("total"))


@query("""with rows_ as (select l.doc_id, quality, n_chars::double as a, len(string_split(text, ' '))::double as b from labels l join documents d on d.doc_id = l.doc_id),
ea as (select unnest(quantile_cont(a, [0.2, 0.4, 0.6, 0.8])) as e from rows_), eb as (select unnest(quantile_cont(b, [0.2, 0.4, 0.6, 0.8])) as e from rows_),
placed as (select *, (select count(*) from ea where a >= e) as ba, (select count(*) from eb where b >= e) as bb from rows_),
oa as (select ba, ln(avg(quality) + 1e-6) - ln(1 - avg(quality) + 1e-6) as odds from placed group by ba), ob as (select bb, ln(avg(quality) + 1e-6) - ln(1 - avg(quality) + 1e-6) as odds from placed group by bb)
select doc_id, round(oa.odds + ob.odds, 4) + 0.0 as score from placed p join oa on oa.ba = p.ba join ob on ob.bb = p.bb""")
def class_naive_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.size(F.split("text", " ")).cast("double")
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("a"), words.alias("b"))
    rows = read(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", "quality", "a", "b")
    return rounded(classifier.score(rows, rows, "doc_id", "quality", ["a", "b"], 5), "score")


@query("""with m as (select quantile_cont(p_retailprice, 0.5) as cut from part) select p_partkey, (p_retailprice > cut)::int as label from part, m""")
def class_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    cut = part.agg(F.percentile("p_retailprice", F.lit(0.5))).scalar()
    return part.select("p_partkey", (F.col("p_retailprice") > cut).cast("int").alias("label"))


# ---- summaries of results

@query(f"""with {OFFSETS} select plane, count(*) as frames, round(min(y), 4) as least_y, round(max(y), 4) as greatest_y, round(avg(y), 4) + 0.0 as mean_y, round(stddev_pop(y), 4) as deviation_y,
round(avg(correlation), 4) + 0.0 as mean_correlation, sum((abs(y) > 18 or abs(x) > 18)::int)::bigint as bad, round(100 * avg((abs(y) > 18 or abs(x) > 18)::int), 2) as bad_percent from offsets group by plane""")
def registration_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = ((F.abs("y") > 18) | (F.abs("x") > 18)).cast("int")
    out = offsets(spark, sf_dir).groupBy("plane").agg(
        F.count("*").alias("frames"), F.min("y").alias("least_y"), F.max("y").alias("greatest_y"), F.avg("y").alias("mean_y"), F.stddev_pop("y").alias("deviation_y"),
        F.avg("correlation").alias("mean_correlation"), F.sum(bad).alias("bad"), F.round(100 * F.avg(bad), 2).alias("bad_percent"),
    )
    return rounded(out, "least_y", "greatest_y", "mean_y", "deviation_y", "mean_correlation")


@query(f"""with {OFFSETS}, f as (select plane, sqrt(y * y + x * x) as magnitude, abs(y) as ay from offsets)
select plane, round(avg(magnitude), 4) as mean_magnitude, round(max(magnitude), 4) as greatest_magnitude, round(avg(ay), 4) as mean_absolute, round(max(ay), 4) as greatest_absolute from f group by plane""")
def deformation_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    magnitude = F.sqrt(F.col("y") * F.col("y") + F.col("x") * F.col("x"))
    out = offsets(spark, sf_dir).groupBy("plane").agg(F.avg(magnitude).alias("mean_magnitude"), F.max(magnitude).alias("greatest_magnitude"), F.avg(F.abs("y")).alias("mean_absolute"), F.max(F.abs("y")).alias("greatest_absolute"))
    return rounded(out, "mean_magnitude", "greatest_magnitude", "mean_absolute", "greatest_absolute")


@query(f"""with {MASKS}, sizes as (select roi, count(*) as pixels, sum(weight) as weight from masks group by roi)
select roi, n_name as recording, pixels, round(weight, 4) as weight, coalesce(s_acctbal > 5000, false) as is_cell from sizes s left join supplier on s_suppkey = roi left join nation on n_nationkey = s_nationkey""")
def roi_statistics_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = supplier_masks(spark, sf_dir).groupBy("roi").agg(F.count("*").alias("pixels"), F.round(F.sum("weight"), 4).alias("weight"))
    labels = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("roi"), "s_nationkey", F.coalesce(F.col("s_acctbal") > 5000, F.lit(False)).alias("is_cell"))
    names = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("recording"))
    out = sizes.join(labels, "roi", "left").join(names, "s_nationkey", "left")
    return out.select("roi", "recording", "pixels", "weight", F.coalesce("is_cell", F.lit(False)).alias("is_cell"))


@query("""select n_name as recording, count(s_suppkey) as selected, count(case when s_acctbal > 5000 then 1 end) as cells, count(s_suppkey) > 0 as processed from nation left join supplier on s_nationkey = n_nationkey group by n_name""")
def recording_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return joined.groupBy(F.col("n_name").alias("recording")).agg(
        F.count("s_suppkey").alias("selected"), F.count(F.when(F.col("s_acctbal") > 5000, 1)).alias("cells"), (F.count("s_suppkey") > 0).alias("processed")
    )


@query("""with j as (select user_id as recording, event_type as status from events)
select recording, case when bool_and(status = 'purchase') then 'completed' when bool_or(status = 'error') then 'failed' when bool_or(status = 'click') then 'processing' else 'scheduled' end as overall,
count(*) as jobs, count(case when status = 'error' then 1 end) as failed from j group by recording""")
def jobs_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("recording"), F.col("event_type").alias("status"))
    return jobs.overall(rows, "recording", "status", done="purchase", failed="error", running="click")


@query("select o_orderpriority as status, count(*) as jobs from orders group by o_orderpriority")
def jobs_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("status")).agg(F.count("*").alias("jobs"))


@query("""with t as (select user_id, min(ts) as first, max(ts) as last, count(*) as n from events group by user_id)
select user_id, n, date_diff('second', first, last) as elapsed, case when date_diff('second', first, last) > 0 then round(n * 3600.0 / date_diff('second', first, last), 4) end as per_hour from t""")
def jobs_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "events").groupBy("user_id").agg(F.date_trunc("second", F.min("ts")).alias("first"), F.date_trunc("second", F.max("ts")).alias("last"), F.count("*").alias("n"))
    elapsed = F.timestamp_diff("SECOND", F.col("first"), F.col("last"))
    return t.select("user_id", "n", elapsed.alias("elapsed"), F.when(elapsed > 0, F.round(F.col("n") * 3600.0 / elapsed, 4)).alias("per_hour"))


# ---- naming and checks

@query("select p_partkey, 'plane_' || p_size as specifier, case when p_size % 2 = 0 then p_size else -1 end as parsed from part")
def catalog_plane_specifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    named = naming.plane_specifier(F.col("p_size"))
    text = F.when(F.col("p_size") % 2 == 0, named).otherwise(F.concat(F.lit("x"), named))
    return part.select("p_partkey", named.alias("specifier"), F.coalesce(naming.parse_plane_specifier(text), F.lit(-1)).alias("parsed"))


@query("select s_suppkey, 'root/multi_recording/' || lower(s_name) as path from supplier")
def catalog_dataset_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select("s_suppkey", naming.dataset_path(F.lit("root"), F.col("s_name")).alias("path"))


@query("select page_id, 'new/place' || substr(url, length(regexp_extract(url, '^[a-z]+://[^/]+')) + 1) as path from pages")
def catalog_relocate(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = F.regexp_extract("url", "^[a-z]+://[^/]+", 0)
    return read(spark, sf_dir, "pages").select("page_id", naming.relocated(F.col("url"), prefix, F.lit("new/place")).alias("path"))


@query("""with b as (select l_suppkey as roi, min(l_partkey) as first, max(l_partkey) as last, count(distinct l_partkey) as n from lineitem group by l_suppkey),
o as (select *, lag(last) over (order by roi) as before from b)
select roi, first, last, n, n = last - first + 1 as contiguous, case when before is null then 'first' when first <= before then 'overlap' when first > before + 1 then 'gap' else 'adjacent' end as relation from o""")
def acquisition_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naming.line_blocks(read(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey")


@query("""select c_custkey, c_acctbal < 0 as negative_balance, c_nationkey not between 0 and 24 as unknown_nation, length(c_name) = 0 as empty_name, (c_acctbal < 0)::int + (c_nationkey not between 0 and 24)::int + (length(c_name) = 0)::int as errors from customer""")
def config_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"negative_balance": F.col("c_acctbal") < 0, "unknown_nation": ~F.col("c_nationkey").between(0, 24), "empty_name": F.length("c_name") == 0}
    return naming.broken_rules(read(spark, sf_dir, "customer"), "c_custkey", rules)
