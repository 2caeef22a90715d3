"""The reference workload's operators as queries on the driver's tables, each with SQL that gives the same rows.

Shapes: traces are events (region user_id, value), masks are lineitem (region l_suppkey, pixel l_partkey, weight
l_quantity), movies are embeddings (frame vec_id, 8 by 8 pixels, plane label), region statistics are parts and suppliers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from imgtrace.functions import temporal
from imgtrace.operators import deconvolution, frames, images, masks, models, movies, rois, tracking
from imgtrace.plans import jobs
from imgtrace.streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    """Rounds, and turns a negative zero into zero."""
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in columns})


# ---- traces

TRACES = """traces as (
    select user_id, (date_diff('day', date '2024-01-01', ts::date) * 2 + hour(ts) // 12)::bigint as bin, avg(value) as f
    from events group by all
)"""
RANKED = """ranked as (select user_id, value, row_number() over (partition by user_id order by ts, event_id) - 1 as frame from events)"""


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select("user_id", temporal.half_day(F.col("ts")).alias("bin"), "value")
    return temporal.binned(events, "user_id", "bin", "value")


def numbered_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.numbered(traces(spark, sf_dir), "user_id", "bin")


def ranked_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.numbered(read(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("user_id", "frame", "value")


def smoothed_sql(sigma: float, reach: int) -> str:
    """Gaussian weights over mirrored traces, as `smooth`."""
    return f"""numbered as (select *, row_number() over (partition by user_id order by bin) - 1 as frame, count(*) over (partition by user_id) as n from traces),
weights as (select k, exp(-0.5 * power(k / {sigma}, 2)) / (select sum(exp(-0.5 * power(q / {sigma}, 2))) from (select unnest(range(-{reach}, {reach + 1})) as q)) as w from (select unnest(range(-{reach}, {reach + 1})) as k)),
wanted as (select a.user_id, a.bin, a.frame, a.f, w, ((a.frame + k) % (2 * n) + 2 * n) % (2 * n) as pos, n from numbered a, weights),
smooth as (select x.user_id, x.bin, x.frame, any_value(x.f) as f, sum(w * b.f) as s from wanted x join numbered b on b.user_id = x.user_id and b.frame = case when pos < x.n then pos else 2 * x.n - 1 - pos end group by x.user_id, x.bin, x.frame)"""


@query(f"""with {TRACES}, {smoothed_sql(1.0, 3)}, low as (
    select *, min(s) over (partition by user_id order by frame rows between 3 preceding and 3 following) as low from smooth
), base as (
    select *, max(low) over (partition by user_id order by frame rows between 3 preceding and 3 following) as baseline from low
) select user_id, bin, round(baseline, 4) + 0.0 as baseline, round(f - baseline, 4) + 0.0 as delta from base""")
def trace_delta_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    smooth = movies.weighted_in_time(numbered_traces(spark, sf_dir), "user_id", "frame", "f", 1.0, 3)  # three deviations, as the running minimum wants
    out = temporal.maximin_baseline(smooth, "user_id", "frame", "smooth", 3)
    return rounded(out.select("user_id", "bin", "baseline", (F.col("f") - F.col("baseline")).alias("delta")), "baseline", "delta")


@query(f"""with {TRACES}, whole as (select bin, sum(f) as total, count(*) as n from traces group by bin)
select user_id, t.bin, round(f - 0.7 * case when n > 1 then (total - f) / (n - 1) else 0 end + 1e-11, 9) + 0.0 as corrected from traces t join whole w on w.bin = t.bin""")
def trace_neuropil_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values end in an exact half of the last digit where the divisor is a power of two; a little is added before rounding, lest the order of a sum decide."""
    out = temporal.neuropil_subtracted(traces(spark, sf_dir), "user_id", "bin", "f", 0.7)
    return rounded(out.select("user_id", "bin", (F.col("corrected") + 1e-11).alias("corrected")), "corrected", digits=9)


@query(f"with {TRACES}, {smoothed_sql(1.0, 4)} select user_id, bin, round(f - (select min(s) from smooth), 4) + 0.0 as delta from smooth")
def trace_constant_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    smooth = movies.weighted_in_time(numbered_traces(spark, sf_dir), "user_id", "frame", "f", 1.0, 4)
    return rounded(temporal.constant_baseline(smooth, "f", "smooth").select("user_id", "bin", "delta"), "delta")


@query(f"""with {TRACES}, base as (select user_id, quantile_cont(f, 0.08) as base from traces group by user_id)
select t.user_id, bin, round(f - base, 4) + 0.0 as delta from traces t join base b on b.user_id = t.user_id""")
def trace_percentile_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(temporal.percentile_baseline(traces(spark, sf_dir), "user_id", "f", 0.08).select("user_id", "bin", "delta"), "delta")


@query("""with m as (select user_id, avg(value) as mean, count(*) as n from events group by user_id),
c as (select e.user_id, sum(power(value - mean, 2)) / any_value(n) as m2, sum(power(value - mean, 3)) / any_value(n) as m3 from events e join m on m.user_id = e.user_id group by e.user_id)
select user_id, case when m2 > 0 then round(m3 / power(m2, 1.5), 4) + 0.0 end as skew from c""")
def trace_skewness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(read(spark, sf_dir, "events").groupBy("user_id").agg(F.skewness("value").alias("skew")), "skew")


@query(f"""with {RANKED} select user_id, frame // 5 as bin, round(avg(value), 4) + 0.0 as f from ranked group by all having count(*) = 5""")
def trace_bin_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(temporal.full_bins(ranked_events(spark, sf_dir), "user_id", "frame", "value", 5), "f")


@query("""with marked as (select event_id, value, event_id // 500 as batch, event_type <> 'error' as good from events),
shares as (select batch, avg(good::int) as share from marked group by batch),
kept as (select m.* from marked m join shares s on s.batch = m.batch where good or share <= 0.5),
numbered as (select *, row_number() over (partition by batch order by event_id) - 1 as k, count(*) over (partition by batch) as n from kept)
select batch, case when n > 10 then k // 10 else 0 end as bin, round(avg(value), 4) + 0.0 as f from numbered where n <= 10 or k < n // 10 * 10 group by all""")
def trace_bin_bad_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    return rounded(temporal.bins_without_bad(events, "event_id", "value", F.col("event_type") == "error", 500, 10), "f")


@query(f"""with {RANKED}, counted as (select *, count(*) over (partition by user_id) as n from ranked),
blocks as (select *, least(frame // 10, greatest(n // 10 - 1, 0)) as block from counted)
select user_id, frame, round(value - avg(value) over (partition by user_id, block), 6) + 0.0 as passed from blocks""")
def trace_block_highpass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(temporal.block_high_pass(ranked_events(spark, sf_dir), "user_id", "frame", "value", 10).select("user_id", "frame", "passed"), "passed", digits=6)


@query("""select user_id, round(sqrt(sum(case when value > 50 then value * value else 0 end)), 4) + 0.0 as energy from events group by user_id""")
def trace_threshold_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(temporal.threshold_energy(read(spark, sf_dir, "events"), "user_id", "value", 50.0), "energy")


@query(f"with {TRACES} select user_id, bin, round(f, 4) + 0.0 as f from traces where user_id in (1, 2, 3, 5, 8, 13) and bin >= 4 and bin < 40 and (bin - 4) % 2 = 0")
def trace_window_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(temporal.read_window(traces(spark, sf_dir), "user_id", "bin", [1, 2, 3, 5, 8, 13], 4, 40, 2), "f")


@query("""select l_partkey, year(l_shipdate) as recording, month(l_shipdate) as frame, round(avg(l_extendedprice), 4) + 0.0 as f from lineitem group by all""")
def trace_cross_recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").groupBy("l_partkey", F.year("l_shipdate").cast("long").alias("recording"), F.month("l_shipdate").cast("long").alias("frame"))
    return rounded(lines.agg(F.avg("l_extendedprice").alias("f")), "f")


@query(f"""with {TRACES}, chosen as (select user_id from events group by user_id order by round(avg(value), 6) desc, user_id limit 10),
mean as (select bin, avg(f) as mean from traces where user_id in (select user_id from chosen) group by bin)
select user_id, count(*) as n, round(case when stddev_pop(f) > 0 and stddev_pop(mean) > 0 then corr(f, mean) end, 4) + 0.0 as correlation from traces t join mean m on m.bin = t.bin group by user_id having count(*) > 2""")
def trace_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = read(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("mean"))
    chosen = rois.top(means, "mean", "user_id", 10)
    return rounded(temporal.correlation_with(traces(spark, sf_dir), chosen, "user_id", "bin", "f").where("n > 2"), "correlation")


@query(f"with {TRACES} select bin, count(*) as n, round(avg(f), 4) + 0.0 as average from traces group by bin having count(*) >= 5")
def trace_population_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(temporal.population_average(traces(spark, sf_dir), "bin", "f", 5), "average")


# ---- frames

MOVIE = """movie as (select vec_id as frame, label, unnest(range(64)) as pixel, unnest(embedding)::double as value from embeddings)"""
OFFSETS = """offsets as (select label as plane, vec_id as frame, (embedding[1] * 10)::double as y, (embedding[2] * 10)::double as x, embedding[3]::double as correlation from embeddings)"""


def movie(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    return images.pixels(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", *keep)


def offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda k: F.col("embedding")[k]
    return read(spark, sf_dir, "embeddings").select(F.col("label").alias("plane"), F.col("vec_id").alias("frame"), (e(0) * 10).cast("double").alias("y"), (e(1) * 10).cast("double").alias("x"), e(2).cast("double").alias("correlation"))


@query(f"""with {MOVIE}, after as (select frame - 1 as frame, pixel, value as next from movie)
select m.pixel, round(greatest(1e-10, sqrt(sum(power(coalesce(next - value, 0), 2)) / count(*))), 4) + 0.0 as deviation from movie m left join after a on a.frame = m.frame and a.pixel = m.pixel group by m.pixel""")
def trace_diff_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(images.frame_steps(read(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "deviation")


@query(f"""with {OFFSETS}, near as (
    select plane, frame, y, list(y) over (partition by plane order by frame rows between 2 preceding and 2 following) as ys from offsets
), medians as (select plane, frame, y, list_sort(list_concat(ys, list_resize([0.0::double], 5 - len(ys), 0.0)))[3] as median from near)
select plane, frame, round(abs(y - median), 4) + 0.0 as apart from medians""")
def frame_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = offsets(spark, sf_dir)
    out = rows.select("plane", "frame", F.abs(F.col("y") - temporal.running_median(rows, "plane", "frame", "y", 2)).alias("apart"))
    return rounded(out, "apart")


@query(f"""with {OFFSETS}, marked as (select *, abs(y) > 18 or abs(x) > 18 as bad from offsets),
ranges as (select plane, avg(bad::int) as share, max(case when not bad then abs(y) end) as good_y, max(abs(y)) as all_y, max(case when not bad then abs(x) end) as good_x, max(abs(x)) as all_x from marked group by plane)
select plane, ceil(case when share < 0.5 then good_y else all_y end)::bigint as margin_y, ceil(case when share < 0.5 then good_x else all_x end)::bigint as margin_x from ranges""")
def frame_valid_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = offsets(spark, sf_dir).withColumn("bad", (F.abs("y") > 18) | (F.abs("x") > 18))
    widest = lambda c: F.ceil(F.when(F.avg(F.col("bad").cast("double")) < 0.5, F.max(F.when(~F.col("bad"), F.abs(c)))).otherwise(F.max(F.abs(c)))).cast("long")
    return rows.groupBy("plane").agg(widest("y").alias("margin_y"), widest("x").alias("margin_x"))


@query("""with placed as (select event_id // 6 as frame, (event_id % 6) // 2 as plane, event_id % 2 as channel, value from events)
select plane, channel, count(*) as frames, round(avg(value), 4) + 0.0 as mean from placed where frame < (select (max(event_id) + 1) // 6 from events) group by all""")
def frame_demux(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = temporal.demultiplexed(read(spark, sf_dir, "events"), "event_id", 3, 2)
    return rounded(placed.groupBy("plane", "channel").agg(F.count("*").alias("frames"), F.avg("value").alias("mean")), "mean")


@query("""with wanted as (select distinct floor(i * (select max(vec_id) from embeddings) / 99.0)::bigint as vec_id from range(100) r(i))
select vec_id, label from embeddings where vec_id in (select vec_id from wanted)""")
def frame_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.evenly_spaced(read(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id", 100)


# ---- masks

MASKS = "masks as (select l_suppkey as roi, l_partkey as pixel, sum(l_quantity) as weight from lineitem group by all)"
CHANNELS = """first as (select distinct l_suppkey as roi, l_partkey as pixel from lineitem where l_returnflag = 'A'),
second as (select distinct l_suppkey as roi, l_partkey as pixel from lineitem where l_returnflag = 'R')"""
PRICES = "prices as (select l_partkey as pixel, month(l_shipdate) as frame, avg(l_extendedprice / l_quantity) as value from lineitem group by all)"
PAIRS = f"""{MASKS}, sizes as (select roi, count(*) as n from masks group by roi),
shared as (select a.roi as a, b.roi as b, count(*) as shared from masks a join masks b on b.pixel = a.pixel and a.roi < b.roi group by all),
pairs as (select s.*, x.n as n_a, y.n as n_b from shared s join sizes x on x.roi = s.a join sizes y on y.roi = s.b)"""


def supplier_masks(spark: SparkSession, sf_dir: str, flag: str | None = None) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem")
    lines = lines.where(F.col("l_returnflag") == flag) if flag else lines
    return lines.groupBy(F.col("l_suppkey").alias("roi"), F.col("l_partkey").alias("pixel")).agg(F.sum("l_quantity").alias("weight"))


def brightest_sql(share: float) -> str:
    """Of each region the pixels whose weight reaches its own quantile."""
    return f"(select roi, pixel, weight from (select l_suppkey as roi, l_partkey as pixel, sum(l_quantity)::double as weight from lineitem group by all) qualify weight >= quantile_cont(weight, {share}) over (partition by roi))"


def brightest(spark: SparkSession, sf_dir: str, share: float) -> DataFrame:
    weighed = supplier_masks(spark, sf_dir).withColumn("weight", F.col("weight").cast("double"))
    least = F.percentile("weight", F.lit(share)).over(Window.partitionBy("roi"))
    return weighed.withColumn("least", least).where("weight >= least").drop("least")


def monthly_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("pixel"), F.month("l_shipdate").cast("long").alias("frame"))
    return lines.agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("value"))


@query(f"with {MASKS} select roi, pixel, round(weight / sum(weight) over (partition by roi), 6) + 0.0 as share from masks")
def mask_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(masks.normalized(supplier_masks(spark, sf_dir), "roi", "weight").select("roi", "pixel", "share"), "share", digits=6)


@query(f"with {MASKS} select roi, pixel, count(*) over (partition by pixel) > 1 as overlaps from masks")
def mask_overlap_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.overlap_flags(supplier_masks(spark, sf_dir), "pixel").select("roi", "pixel", "overlaps")


@query(f"with {MASKS} select pixel, count(*) as regions from masks group by pixel")
def mask_overlap_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.overlap_count(supplier_masks(spark, sf_dir), "pixel")


@query(f"""with {MASKS}, {PRICES}, shares as (select roi, pixel, weight / sum(weight) over (partition by roi) as share from masks)
select roi, frame, round(sum(share * value), 4) + 0.0 as f from shares s join prices p on p.pixel = s.pixel group by all""")
def mask_extract_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = masks.normalized(supplier_masks(spark, sf_dir), "roi", "weight")
    return rounded(masks.extract_trace(shares, monthly_prices(spark, sf_dir), "roi", "pixel", "frame", "share", "value"), "f")


@query(f"""with {PRICES}, held as (select distinct l_partkey as pixel from lineitem where l_quantity >= 48)
select frame, count(*) as pixels, round(avg(value), 4) + 0.0 as background from prices where pixel not in (select pixel from held) group by frame""")
def mask_neuropil_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = read(spark, sf_dir, "lineitem").where("l_quantity >= 48").select(F.col("l_partkey").alias("pixel"))
    return rounded(masks.background_mean(held, monthly_prices(spark, sf_dir), "pixel", "frame", "value"), "background")


@query(f"with {MASKS} select pixel, max(weight) as weight from masks group by pixel")
def mask_max_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supplier_masks(spark, sf_dir).groupBy("pixel").agg(F.max("weight").alias("weight"))


@query(f"with {PAIRS} select a, b, shared, round(shared / (n_a + n_b - shared), 6) + 0.0 as jaccard from pairs")
def mask_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(masks.jaccard(supplier_masks(spark, sf_dir), "roi", "pixel").select("a", "b", "shared", "jaccard"), "jaccard", digits=6)


@query(f"with {PAIRS} select a, b, round(shared / least(n_a, n_b), 6) + 0.0 as overlap from pairs")
def mask_min_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(masks.least_overlap(supplier_masks(spark, sf_dir), "roi", "pixel").select("a", "b", "overlap"), "overlap", digits=6)


@query(f"""with {CHANNELS}, n1 as (select roi, count(*) as n from first group by roi), n2 as (select roi, count(*) as n from second group by roi),
shared as (select a.roi as a, b.roi as b, count(*) as shared from first a join second b on b.pixel = a.pixel group by all),
scored as (select s.a, s.b, shared / least(n1.n, n2.n) as score from shared s join n1 on n1.roi = s.a join n2 on n2.roi = s.b),
ranked as (select *, row_number() over (partition by a order by score desc, b) as ra, row_number() over (partition by b order by score desc, a) as rb from scored),
matched as (select * from ranked where ra = 1 and rb = 1 and score >= 0.1)
select n1.roi as a, coalesce(m.b, -1) as matched, round(coalesce(m.score, 0), 6) + 0.0 as score from n1 left join matched m on m.a = n1.roi""")
def mask_mutual_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = masks.mutual_matches(supplier_masks(spark, sf_dir, "A"), supplier_masks(spark, sf_dir, "R"), "roi", "pixel", 0.1)
    return rounded(out, "score", digits=6)


@query(f"""with {MASKS}, image as (select p_partkey as pixel, p_retailprice as value from part), whole as (select sum(value) as total, count(*) as n from image),
inside as (select roi, greatest(1e-3, sum(weight * value) / sum(weight)) as inside, sum(value) as own, count(*) as own_n from masks m join image i on i.pixel = m.pixel group by roi)
select roi, round(inside, 4) + 0.0 as inside, round(inside / (inside + case when n > own_n then (total - own) / (n - own_n) else 0 end), 6) + 0.0 as probability from inside, whole""")
def mask_intensity_coloc(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("pixel"), F.col("p_retailprice").alias("value"))
    out = masks.intensity_colocalization(supplier_masks(spark, sf_dir), image, "roi", "pixel", "weight", "value")
    return rounded(rounded(out, "inside"), "probability", digits=6)


@query(f"with {MASKS} select roi, pixel from masks where pixel not in (select l_partkey from lineitem where l_quantity >= 48)")
def mask_setdiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    others = read(spark, sf_dir, "lineitem").where("l_quantity >= 48").select(F.col("l_partkey").alias("pixel"))
    return masks.without(supplier_masks(spark, sf_dir), others, "pixel").select("roi", "pixel")


@query("""with masks as (select distinct l_suppkey as roi, l_partkey as pixel from lineitem), steps(dy, dx) as (values (0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)),
moved as (select roi, pixel // 100 + dy as y, pixel % 100 + dx as x from masks, steps)
select distinct roi, y * 100 + x as pixel from moved where y between 0 and 999 and x between 0 and 99""")
def mask_dilate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.dilated(supplier_masks(spark, sf_dir), "roi", "pixel", 100, 1000)


# ---- templates and tracking

MEMBERS = """members as (select l_suppkey as cluster, year(l_shipdate) as member, l_partkey as pixel, avg(l_quantity) as weight from lineitem group by all)"""


def cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("cluster"), F.year("l_shipdate").cast("long").alias("member"), F.col("l_partkey").alias("pixel"))
    return lines.agg(F.avg("l_quantity").alias("weight"))


@query(f"""with {MEMBERS}, sizes as (select cluster, count(distinct member) as n from members group by cluster)
select m.cluster, pixel, count(*) as holders, round(avg(weight), 4) + 0.0 as weight from members m join sizes s on s.cluster = m.cluster group by m.cluster, pixel, n having count(*) * 100 >= 25 * n""")
def template_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(masks.consensus(cluster_members(spark, sf_dir), "cluster", "member", "pixel", "weight", 25), "weight")


@query(f"""with masks as {brightest_sql(0.96)},
flagged as (select roi, count(*) over (partition by pixel) > 1 as many from masks)
select roi, count(*) as pixels, sum(case when many then 0 else 1 end)::bigint as own from flagged group by roi having sum(case when many then 0 else 1 end) >= 6""")
def template_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.large_enough(brightest(spark, sf_dir, 0.96), "roi", "pixel", 6)


@query(f"with {MEMBERS}, held as (select cluster, pixel, count(*) as recordings from members group by all) select recordings, count(*) as templates from held group by recordings")
def template_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = cluster_members(spark, sf_dir).groupBy("cluster", "pixel").agg(F.count("*").alias("recordings"))
    return held.groupBy("recordings").agg(F.count("*").alias("templates"))


@query("""with c as (select c_custkey as roi, c_nationkey as recording, c_acctbal as y, c_custkey * 7.0 as x from customer)
select a.roi as a, b.roi as b, round(sqrt(power(a.y - b.y, 2) + power(a.x - b.x, 2)), 4) + 0.0 as distance from c a join c b on a.roi < b.roi and a.recording <> b.recording and power(a.y - b.y, 2) + power(a.x - b.x, 2) < 10000""")
def band_join_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    centres = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("roi"), F.col("c_nationkey").alias("recording"), F.col("c_acctbal").alias("y"), (F.col("c_custkey") * 7.0).alias("x"))
    return rounded(masks.near_pairs(centres, "roi", "recording", "y", "x", 100.0), "distance")


# ---- regions

@query("""select p_partkey, p_size, p_retailprice from part where p_retailprice >= 950 and p_size <= 30 and abs(p_size - 10) > 2 and abs(p_size - 20) > 2""")
def roi_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rois.select(read(spark, sf_dir, "part"), "p_retailprice", "p_size", "p_size", [10, 20], 950.0, 30, 2.0).select("p_partkey", "p_size", "p_retailprice")


@query("select s_suppkey, s_nationkey, s_acctbal from supplier order by coalesce(s_acctbal, 0) desc, s_suppkey limit 50")
def roi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rois.top(read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), "s_acctbal", "s_suppkey", 50)


PLACED = "placed as (select l_suppkey as roi, l_partkey // 100 as y, l_partkey % 100 as x, l_quantity as weight from lineitem)"


def placed_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("roi"), F.floor(F.col("l_partkey") / 100).alias("y"), (F.col("l_partkey") % 100).alias("x"), F.col("l_quantity").alias("weight"))


@query(f"""with {PLACED}, s as (select roi, sum(weight) as w, sum(weight * y) as wy, sum(weight * x) as wx, sum(weight * y * y) as wyy, sum(weight * x * x) as wxx, sum(weight * y * x) as wyx from placed group by roi),
c as (select roi, wyy / w - power(wy / w, 2) as a, wxx / w - power(wx / w, 2) as b, wyx / w - wy / w * wx / w as c from s),
r as (select roi, 2.5 * sqrt(greatest((a + b) / 2 + sqrt(power((a - b) / 2, 2) + c * c), 0)) as major, 2.5 * sqrt(greatest((a + b) / 2 - sqrt(power((a - b) / 2, 2) + c * c), 0)) as minor from c)
select roi, round(major, 4) + 0.0 as major, round(minor, 4) + 0.0 as minor, round(2 * major / (major + minor + 0.01), 4) + 0.0 as aspect_ratio from r""")
def roi_ellipse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rois.ellipse(placed_pixels(spark, sf_dir), "roi", "y", "x", "weight"), "major", "minor", "aspect_ratio")


@query(f"""with {PLACED}, m as (select roi, quantile_cont(y, 0.5) as my, quantile_cont(x, 0.5) as mx, count(*) as n from placed group by roi),
r as (select p.roi, avg(sqrt(power(y - my, 2) + power(x - mx, 2))) as radius, any_value(n) as pixels from placed p join m on m.roi = p.roi group by p.roi)
select roi, pixels, round(radius, 4) + 0.0 as radius, round(greatest(1, radius / (1e-10 + 2.0 / 3.0 * sqrt(pixels / pi()))), 4) + 0.0 as compactness from r""")
def roi_compactness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rois.compactness(placed_pixels(spark, sf_dir), "roi", "y", "x"), "radius", "compactness")


@query("""with s as (select l_suppkey, count(*) as pixels from lineitem group by l_suppkey) select greatest(1, floor(2 * sqrt(quantile_cont(pixels, 0.5) / pi())))::bigint as diameter from s""")
def roi_diameter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rois.diameter(read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("pixels")), "pixels")


@query("""with s as (select l_suppkey, count(*) as pixels from lineitem group by l_suppkey), f as (select avg(pixels) as mean from (select pixels from s order by l_suppkey limit 100))
select l_suppkey, pixels, round(pixels / mean, 4) + 0.0 as normalized from s, f""")
def roi_norm_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("pixels"))
    return rounded(rois.normalized_size(sizes, "l_suppkey", "pixels"), "normalized")


# ---- images

@query(f"with {MOVIE} select pixel, round(avg(value), 4) + 0.0 as mean, round(max(value), 4) + 0.0 as maximum, round(stddev_pop(value), 4) + 0.0 as deviation from movie group by pixel")
def image_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = images.projection(movie(spark, sf_dir)).withColumn("pixel", F.col("pixel").cast("long"))
    return rounded(out, "mean", "maximum", "deviation")


@query(f"with {MOVIE} select frame, (pixel // 8 // 2) * 4 + (pixel % 8) // 2 as pixel, round(avg(value), 5) + 0.0 as value from movie group by all")
def image_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = frames.per_frame(read(spark, sf_dir, "embeddings"), "embedding", 8, 8, lambda x, _: frames.halved(x, False), ["vec_id"])
    return rounded(frames.as_pixels(out.withColumnRenamed("vec_id", "frame"), "frame"), "value", digits=5)


@query("""with small as (select vec_id as frame, unnest(range(35)) as pixel, unnest(embedding[1:35])::double as value from embeddings)
select frame, pixel // 5 // 2 * 3 + pixel % 5 // 2 as pixel, round(sum(value) / 4, 5) + 0.0 as tapered, round(avg(value), 5) + 0.0 as value from small group by all""")
def image_downsample_odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    small = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.slice("embedding", 1, 35).alias("v"))
    plain, tapered = (frames.per_frame(small, "v", 7, 5, lambda x, _, t=t: frames.halved(x, t), ["frame"]) for t in (False, True))
    both = frames.as_pixels(plain, "frame").join(frames.as_pixels(tapered, "frame").withColumnRenamed("value", "tapered"), ["frame", "pixel"])
    return rounded(both, "value", "tapered", digits=5)


@query(f"""with {MOVIE}, means as (select label, avg(value) as mean from movie group by label),
side as (select unnest(range(8)) as i), mask as (select i, 1 / (1 + exp((abs(i - 3.5) - (3.5 - 2 * 0.8)) / 0.8)) as s from side),
masked as (select m.frame, m.pixel, m.value, e.mean, a.s * b.s as mask from movie m join means e on e.label = m.label join mask a on a.i = m.pixel // 8 join mask b on b.i = m.pixel % 8)
select frame, pixel, round(value * mask + mean * (1 - mask), 5) + 0.0 as value from masked""")
def image_taper(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = movie(spark, sf_dir, "label").groupBy("label").agg(F.avg("value").alias("mean"))
    rows = read(spark, sf_dir, "embeddings").join(F.broadcast(means), "label")
    out = frames.per_frame(rows, "embedding", 8, 8, lambda x, other: frames.tapered(x, frames.taper_mask(8, 8, 0.8), other["mean"]), ["vec_id", "mean"])
    return rounded(frames.as_pixels(out.select(F.col("vec_id").alias("frame"), "pixels"), "frame"), "value", digits=5)


@query(f"""with {MOVIE}, mean_ as (select label, pixel, avg(value) as value from movie group by all),
near as (select a.label, a.pixel, any_value(a.value) as value, list(b.value) as v from mean_ a join mean_ b on b.label = a.label and abs(b.pixel // 8 - a.pixel // 8) <= 2 and abs(b.pixel % 8 - a.pixel % 8) <= 2 group by a.label, a.pixel),
left_ as (select label, pixel, value - list_sort(list_concat(v, list_transform(range(25 - len(v)), lambda i: 0.0::double)))[13] as value from near),
again as (select a.label, a.pixel, any_value(a.value) as value, list(abs(b.value)) as v from left_ a join left_ b on b.label = a.label and abs(b.pixel // 8 - a.pixel // 8) <= 2 and abs(b.pixel % 8 - a.pixel % 8) <= 2 group by a.label, a.pixel)
select label, pixel, round(least(greatest((value / (list_sort(list_concat(v, list_transform(range(25 - len(v)), lambda i: 0.0::double)))[13] + 1e-10) + 6) / 12, 0), 1), 4) + 0.0 as value from again""")
def image_enhanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = movie(spark, sf_dir, "label").groupBy("label", "pixel").agg(F.avg("value").alias("value"))
    planes = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pixel", "value"))), lambda x: x.value).alias("image"))
    out = frames.per_frame(planes, "image", 8, 8, lambda x, _: frames.enhanced(x, 1.0), ["label"])
    return rounded(frames.as_pixels(out, "label"), "value")


@query(f"""with {MOVIE}, means as (select a.frame, a.pixel, avg(b.value) as mean from movie a join movie b on b.frame = a.frame and abs(b.pixel // 8 - a.pixel // 8) <= 1 and abs(b.pixel % 8 - a.pixel % 8) <= 1 group by all)
select m.frame, m.pixel, round(value - mean, 5) + 0.0 as passed from movie m join means a on a.frame = m.frame and a.pixel = m.pixel""")
def image_box_highpass(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = frames.per_frame(read(spark, sf_dir, "embeddings"), "embedding", 8, 8, lambda x, _: frames.box_high_pass(x, 1), ["vec_id"])
    return rounded(frames.as_pixels(out.withColumnRenamed("vec_id", "frame"), "frame").withColumnRenamed("value", "passed"), "passed", digits=5)


@query(f"""with {MOVIE}, ends as (select frame, quantile_cont(value, 0.01) as low, quantile_cont(value, 0.99) as high from movie group by frame)
select m.frame, pixel, round(case when high > low then least(greatest((value - low) / (high - low), 0), 1) else 0 end, 5) + 0.0 as scaled from movie m join ends e on e.frame = m.frame""")
def image_percentile_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = frames.per_frame(read(spark, sf_dir, "embeddings"), "embedding", 8, 8, lambda x, _: frames.percentile_normalized(x, 1, 99), ["vec_id"])
    return rounded(frames.as_pixels(out.withColumnRenamed("vec_id", "frame"), "frame").withColumnRenamed("value", "scaled"), "scaled", digits=5)


@query("""with p as (select label, row_number() over (order by label) - 1 as k, count(*) over () as n from (select distinct label from embeddings)),
c as (select *, ceil(sqrt(64 * n) / 8)::bigint as columns from p) select label, (k // columns) * 8 as y, (k % columns) * 8 as x from c""")
def image_mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.mosaic_offsets(read(spark, sf_dir, "embeddings"), "label", 8, 8)


@query("""with v as (select vec_id as frame, label as plane, list_transform(embedding, lambda x: x::double) as v from embeddings),
c as (select frame, plane, list_transform(v, lambda x: x - list_sum(v) / 64) as v from v)
, pairs as (select a.plane, a.frame, b.frame as other, round(list_sum(list_transform(range(1, 65), lambda i: a.v[i] * b.v[i])) / (sqrt(list_sum(list_transform(a.v, lambda x: x * x))) * sqrt(list_sum(list_transform(b.v, lambda x: x * x)))), 6) as correlation
    from c a join c b on b.plane = a.plane and b.frame <> a.frame)
, ranked as (select *, row_number() over (partition by frame order by correlation desc, other) as place from pairs)
select plane, frame, other, correlation + 0.0 as correlation, place from ranked where place <= 20""")
def frame_similarity_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = images.similar_frames(read(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding", 20)
    return out.withColumn("correlation", F.col("correlation") + 0.0)


@query(f"""with {MOVIE} select label, round(min(value), 4) as least, round(max(value), 4) as greatest, round(avg(value), 4) + 0.0 as mean, round(stddev_pop(value), 4) as deviation from movie group by label""")
def array_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.summary(movie(spark, sf_dir, "label"), ["label"], F.col("value")).withColumn("mean", F.col("mean") + 0.0)


# ---- classification, catalogue, jobs

@query("""with rows as (select quality, d.n_chars::double as size from labels l join documents d on d.doc_id = l.doc_id),
edges as (select unnest(quantile_cont(size, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) as edge from rows),
placed as (select quality, (select count(*) from edges where size >= edge) as bin from rows),
shares as (select bin, count(*) as n, least(greatest(avg(quality), 1e-3), 1 - 1e-3) as share from placed group by bin)
select bin, n, round(share, 6) as share, round(ln(share / (1 - share)), 4) + 0.0 as log_odds from shares""")
def class_grid_logodds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("size")), "doc_id")
    out = rois.grid_log_odds(rows, "quality", "size", 10).withColumns({"bin": F.col("bin").cast("long"), "share": F.round("share", 6)})
    return rounded(out, "log_odds")


@query("""with parts as (select url as path, unnest(string_split(url, '/')) as part, unnest(range(len(string_split(url, '/')))) as place from (select distinct url from pages)),
held as (select part from parts where part <> '' group by part having count(distinct path) = 1),
own as (select path, arg_max(part, place) as component from parts where part in (select part from held) group by path)
select p.url as path, component from (select distinct url from pages) p left join own o on o.path = p.url""")
def catalog_unique_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rois.unique_component(read(spark, sf_dir, "pages"), "url")


# ---- kernels in Arrow batches, models, jobs and streams

@query()
def trace_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deconvolution.spikes(ranked_events(spark, sf_dir), "user_id", "frame", "value", 0.7, 10.0)


@query()
def cluster_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem")
    members = lines.select((F.col("l_suppkey") * 10 + F.year("l_shipdate") % 10).alias("roi"), F.col("l_suppkey").alias("bin"), F.year("l_shipdate").alias("recording"), F.col("l_partkey").alias("pixel"))
    return tracking.clusters(members, "bin", "recording", "roi", "pixel", 0.97)


@query("""with recursive phases(phase, needs) as (values ('binarize', null), ('register', 'binarize'), ('detect', 'register'), ('extract', 'detect'), ('combine', 'extract')),
done as (select label as plane, min(vec_id % 5 + label % 5) as reached from embeddings group by label),
jobs as (select plane, phase, needs, row_number() over (partition by plane order by case phase when 'binarize' then 0 when 'register' then 1 when 'detect' then 2 when 'extract' then 3 else 4 end) - 1 as k, reached from done, phases)
select plane, phase from jobs where k = reached""")
def jobs_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    reached = read(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("plane")).agg(F.min(F.col("vec_id") % 5 + F.col("label") % 5).alias("reached"))
    return jobs.ready(jobs.finished_up_to(reached, "plane", "reached"), reached.select("plane"))


@query("""with expected as (select distinct label as plane, kind from embeddings, (values ('mean'), ('maximum'), ('traces')) k(kind)),
actual as (select distinct label as plane, case when vec_id % 3 = 0 then 'mean' when vec_id % 3 = 1 then 'maximum' end as kind from embeddings)
select e.plane, e.kind from expected e where not exists (select 1 from actual a where a.plane = e.plane and a.kind = e.kind)""")
def config_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = read(spark, sf_dir, "embeddings").select(F.col("label").alias("plane"), "vec_id")
    actual = frames.select("plane", F.when(F.col("vec_id") % 3 == 0, "mean").when(F.col("vec_id") % 3 == 1, "maximum").alias("kind"))
    return jobs.missing(frames.select("plane").distinct(), actual, "plane", ["mean", "maximum", "traces"])


@query("""select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 3) + 0.0 as total from events group by all""")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(windows.tumbling(spark, f"{sf_dir}/events.parque[t]", "ts", "1 hour", "event_type", "value"), "total", digits=3)


@query(f"""with steps as (select user_id, ts, value, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 6 hour then 0 else 1 end as new, event_id from events),
numbered as (select *, sum(new) over (partition by user_id order by ts, event_id) as session from steps)
select user_id, min(ts) as start, count(*) as n, round(sum(value), 3) + 0.0 as total from numbered group by user_id, session""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(windows.streamed_sessions(spark, f"{sf_dir}/events.parque[t]", "user_id", "ts", "value", "6 hours"), "total", digits=3)


@query()
def class_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("size")), "doc_id")
    return models.predict(rows, "doc_id", "quality", ["size"])


@query()
def image_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.principal_components(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", 5)
