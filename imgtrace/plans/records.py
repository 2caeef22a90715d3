"""Queries over recordings, their jobs, files, settings and regions; each with SQL that gives the same rows.

Shapes: recordings are nations, their planes the suppliers' numbers modulo 4, regions parts or suppliers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from imgtrace.functions import naming, temporal
from imgtrace.operators import alignment, catalog, classifier, extraction, images, masks, shape, tracking
from imgtrace.operators.graphs import checkpointed
from imgtrace.plans import jobs
from imgtrace.plans.catalogue import MASKS, brightest, brightest_sql, MOVIE, OFFSETS, PLACED, PRICES, TRACES, monthly_prices, movie, offsets, placed_pixels, query, read, rounded, supplier_masks, traces

# ---- jobs

JOBS = """phases(phase, needs, each, same, k) as (values ('binarize', null, false, false, 0), ('register', 'binarize', true, false, 1), ('process', 'register', true, true, 2), ('combine', 'process', false, false, 3)),
specs as (select distinct s_nationkey as recording, 'plane_' || (s_suppkey % 4) as specifier from supplier),
named as (select recording, phase, specifier, k from specs, phases where each union all select recording, phase, '', k from (select distinct recording from specs), phases where not each),
jobs as (select recording, phase, specifier, k, substring(sha256(recording || '|' || phase || '|' || specifier), 1, 16) as job_id from named)"""
EDGES = """edges as (select a.job_id, b.job_id as needs_id from jobs a join phases p on p.phase = a.phase join jobs b on b.recording = a.recording and b.phase = p.needs and (not p.same or a.specifier = b.specifier))"""


def planned_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    planes = read(spark, sf_dir, "supplier").select("s_nationkey", naming.plane_specifier(F.col("s_suppkey") % 4).alias("specifier"))
    return jobs.universe(planes, "s_nationkey", "specifier")


@query(f"with {JOBS} select recording, phase, specifier, k, job_id from jobs")
def jobs_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planned_jobs(spark, sf_dir)


@query(f"with {JOBS}, {EDGES} select job_id, needs_id from edges")
def jobs_prerequisites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.prerequisites(planned_jobs(spark, sf_dir))


@query(f"""with {JOBS}, {EDGES}, fine as (select job_id from jobs where k = 0 or k = 1 and recording < 12 or k = 2),
open_ as (select job_id, count(*) as n from edges where needs_id not in (select job_id from fine) group by job_id)
select j.job_id, coalesce(n, 0) as waits_for, n is null as runnable from jobs j left join open_ o on o.job_id = j.job_id where k = 2""")
def jobs_runnable(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = planned_jobs(spark, sf_dir)
    succeeded, submitted = every.where("k = 0 or (k = 1 and recording < 12)"), every.where("k = 2")
    return jobs.runnable(every, jobs.prerequisites(every), succeeded, submitted)


ASKED = """asked as (select s_nationkey as recording, case s_suppkey % 5 when 0 then 'combine' when 1 then 'process' when 2 then 'archive' when 3 then 'register' else 'backup' end as phase from supplier)"""


def asked_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*(F.lit(n) for n in ("combine", "process", "archive", "register", "backup"))), (F.col("s_suppkey") % 5 + 1).cast("int"))
    return read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("recording"), name.alias("phase"))


@query(f"""with {JOBS}, {ASKED}, first as (select a.recording, min(k) as first from asked a join phases p on p.phase = a.phase group by a.recording)
select f.recording, p.phase from first f join phases p on p.k >= f.first""")
def jobs_downstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.downstream(asked_phases(spark, sf_dir), "recording", "phase")


@query(f"""with {JOBS}, {ASKED}, pairs as (select distinct a.recording, a.phase, p.k from asked a left join phases p on p.phase = a.phase)
select recording, phase, row_number() over (partition by recording order by k nulls last, phase) as place from pairs""")
def jobs_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("recording").orderBy(*jobs.execution_place(F.col("phase"))))
    return asked_phases(spark, sf_dir).distinct().withColumn("place", place.cast("long"))


@query("""select s_nationkey as recording, 1 as binarize, sum((s_acctbal > 0)::int)::bigint as register, sum((s_acctbal > 3000)::int)::bigint as process, min((s_acctbal > -900)::int)::bigint as combine from supplier group by s_nationkey""")
def jobs_ready_by_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    planes = read(spark, sf_dir, "supplier").selectExpr("s_nationkey", "s_acctbal > 0 as converted", "s_acctbal > 3000 as registered", "s_acctbal > -900 as processed")
    return jobs.ready_single(planes, "s_nationkey", "converted", "registered", "processed")


NATIONS = """counts as (select n_regionkey as dataset, n_nationkey as recording, n_name, count(s_suppkey) as planes, coalesce(max(s_acctbal), 0) as most from nation left join supplier on s_nationkey = n_nationkey group by all)"""


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return joined.groupBy(F.col("n_regionkey").alias("dataset"), F.col("n_nationkey").alias("recording"), "n_name").agg(F.count("s_suppkey").alias("planes"), F.coalesce(F.max("s_acctbal"), F.lit(0.0)).alias("most"))


@query(f"with {NATIONS} select dataset, min((planes > 0)::int) = 1 as discover, sum((most > 9000)::int)::bigint as extract from counts group by dataset")
def datasets_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.ready_multi(recordings(spark, sf_dir).selectExpr("dataset", "planes > 0 as processed", "most > 9000 as tracked"), "dataset", "processed", "tracked")


@query(f"""with {NATIONS} select dataset, count(distinct recording) as recordings, sum((planes > 0)::int)::bigint as processed, sum((most > 9000)::int)::bigint as extractable,
arg_min(planes > 3, recording) as discovered from counts group by dataset""")
def dataset_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = recordings(spark, sf_dir).selectExpr("dataset", "recording", "planes > 0 as processed", "most > 9000 as tracked", "planes > 3 as template")
    return catalog.dataset_progress(rows, "dataset", "recording", "processed", "tracked", "recording", "template")


@query("""with planes as (select distinct s_nationkey as recording, s_suppkey % 4 as plane from supplier),
files as (select s_nationkey as recording, s_suppkey % 4 as plane, bool_or(s_acctbal > 0) as converted, bool_or(s_acctbal between 0 and 7000) as registered, bool_or(s_acctbal > 8000) as processed from supplier group by all)
select p.recording, p.plane, converted, registered, processed, (converted)::int + (converted and registered)::int + (converted and registered and processed)::int as reached from planes p join files f on f.recording = p.recording and f.plane = p.plane""")
def plane_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("recording"), (F.col("s_suppkey") % 4).alias("plane"), "s_acctbal")
    kinds = F.array_compact(F.array(F.when(F.col("s_acctbal") > 0, "binary"), F.when(F.col("s_acctbal").between(0, 7000), "reference"), F.when(F.col("s_acctbal") > 8000, "traces")))
    files = rows.select("recording", "plane", F.explode(kinds).alias("kind"))
    return catalog.plane_progress(rows, files, ["recording", "plane"], "kind", {"converted": "binary", "registered": "reference", "processed": "traces"})


# ---- names and paths

@query("""select p_partkey, p_brand || '/plane_' || p_size || '/' || p_type || case when p_retailprice > 1000 then '_channel_2' else '' end || '.npy' as path from part""")
def catalog_array_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", catalog.array_path(F.col("p_brand"), F.col("p_size"), F.col("p_type"), F.col("p_retailprice") > 1000).alias("path"))


@query("""with p as (select page_id, url as old, 'store/x/' || regexp_replace(url, '^[a-z]+://[^/]+/', '') as new from pages),
a as (select *, list_reverse(string_split(old, '/')) as ra, list_reverse(string_split(new, '/')) as rb from p),
s as (select *, coalesce(nullif(list_position(list_transform(range(1, greatest(len(ra), len(rb)) + 1), lambda i: coalesce(ra[i] = rb[i], false)), false), 0), greatest(len(ra), len(rb)) + 1) - 1 as shared from a)
select page_id, array_to_string(list_reverse(ra[shared + 1:]), '/') as old_prefix, array_to_string(list_reverse(rb[shared + 1:]), '/') as new_prefix from s""")
def catalog_relocation_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.concat(F.lit("store/x/"), F.regexp_replace("url", "^[a-z]+://[^/]+/", ""))
    found = read(spark, sf_dir, "pages").select("page_id", catalog.relocation_prefixes(F.col("url"), moved).alias("p"))
    return found.select("page_id", F.col("p.old").alias("old_prefix"), F.col("p.new").alias("new_prefix"))


@query("""with p as (select page_id, string_split(url, '/') as parts from pages) select array_to_string(parts[1:greatest(len(parts) - 1, 0)], '/') as root, min(page_id) as first from p group by all""")
def catalog_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.roots(read(spark, sf_dir, "pages"), "url", "page_id", 1)


@query("""with d as (select distinct l_suppkey, l_linenumber * 64 as x from lineitem), r as (select *, row_number() over (partition by l_suppkey order by x) as k from d)
select l_suppkey, coalesce(string_agg(x::varchar, ',' order by x) filter (where k > 1), '') as borders from r group by l_suppkey""")
def catalog_region_borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_linenumber") * 64).alias("x"))
    return catalog.region_borders(rows, "l_suppkey", "x").withColumn("borders", F.array_join(F.col("borders").cast("array<string>"), ","))


# ---- conversion

@query("""with g as (select user_id as recording, count(*) as pages, 8 as height, min(length(event_type)) as width, min(length(event_type)) = max(length(event_type)) as uniform from events group by user_id)
select recording, pages, pages // 4 as frames, pages % 4 as left_over, case when not uniform then 'pages differ' when pages // 4 = 0 then 'no full cycle' when pages % 4 > 0 then 'last cycle dropped' else 'ok' end as state from g""")
def conversion_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "events").select(F.col("user_id").alias("recording"), F.lit(8).alias("h"), F.length("event_type").alias("w"), F.lit("int16").alias("kind"))
    plan = catalog.conversion_plan(catalog.source_geometry(pages, "recording", "h", "w", "kind"), F.lit(2), F.lit(2))
    return plan.select("recording", "pages", "frames", "left_over", "state")


@query("""select vec_id, pixel - 15 as place, round(embedding[pixel]::double, 5) + 0.0 as value from embeddings, (select unnest(range(17, 41)) as pixel) where pixel between 17 and 40""")
def frame_row_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(catalog.row_slice(F.col("embedding"), 8, F.lit(2), F.lit(4))).alias("k", "value"))
    return rounded(rows.select("vec_id", (F.col("k") + 2).cast("long").alias("place"), F.col("value").cast("double").alias("value")), "value", digits=5)


@query("""select p_partkey, p_size::bigint * 16 * 8 * 2 as expected, p_size::bigint * 16 * 8 * 2 = (p_retailprice * 4)::bigint as fits from part""")
def binary_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select("p_partkey", F.round(F.col("p_retailprice") * 4).cast("long").alias("bytes"), "p_size", F.lit(16).alias("h"), F.lit(8).alias("w"))
    return catalog.binary_sizes(rows, "bytes", "p_size", "h", "w").select("p_partkey", "expected", "fits")


@query("""with n as (select l_suppkey, count(*) as frames from lineitem group by l_suppkey)
select l_suppkey, frames, case when l_suppkey % 8 in (0, 7) then 'flyback' when frames < 50 then 'too few frames' when frames < 610 then 'few frames' else 'ok' end as state from n""")
def plane_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("frames")).withColumn("plane", F.col("l_suppkey") % 8)
    return catalog.usable_planes(counts, "plane", "frames", [0, 7], few=610).select("l_suppkey", "frames", "state")


# ---- settings

@query("""with saved as (select c_custkey, c_nationkey, c_mktsegment from customer where c_mktsegment = 'BUILDING'), raw as (select c_custkey, c_nationkey + 100 as c_nationkey, lower(c_mktsegment) as c_mktsegment from customer where c_acctbal > 0)
select coalesce(s.c_custkey, r.c_custkey) as c_custkey, case when s.c_custkey is not null then 'saved' else 'raw' end as origin, coalesce(s.c_nationkey, r.c_nationkey) as c_nationkey, coalesce(s.c_mktsegment, r.c_mktsegment) as c_mktsegment
from saved s full join raw r on r.c_custkey = s.c_custkey""")
def acquisition_preferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = read(spark, sf_dir, "customer")
    saved = customers.where("c_mktsegment = 'BUILDING'")
    raw = customers.where("c_acctbal > 0").select("c_custkey", (F.col("c_nationkey") + 100).alias("c_nationkey"), F.lower("c_mktsegment").alias("c_mktsegment"))
    return catalog.preferred(saved, raw, "c_custkey", ["c_nationkey", "c_mktsegment"])


@query("""with s as (select s_nationkey, s_suppkey, s_suppkey % 10 as a, s_suppkey % 10 + s_nationkey % 5 - 1 as b from supplier) select s_nationkey, s_suppkey, unnest(range(a, b + 1)) as line from s where a <= b""")
def acquisition_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = read(spark, sf_dir, "supplier").selectExpr("s_nationkey", "s_suppkey", "s_suppkey % 10 as a", "s_suppkey % 10 + s_nationkey % 5 - 1 as b")
    return catalog.expanded_spans(spans, "s_nationkey", "s_suppkey", "a", "b")


@query("""with l as (select s_nationkey, list(s_suppkey order by s_suppkey) as lines from supplier group by s_nationkey)
select s_nationkey, array_to_string(lines[s_nationkey % 4 + 1:s_nationkey % 4 + 3], ',') as part from l""")
def acquisition_line_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list("s_suppkey")).alias("lines"))
    part = catalog.bounded_slice(F.col("lines"), F.col("s_nationkey") % 4, F.lit(3))
    return lines.select("s_nationkey", F.array_join(part.cast("array<string>"), ",").alias("part"))


@query("""with d(name, fallback) as (values ('BUILDING', '3'), ('AUTOMOBILE', '7'), ('MACHINERY', null)), s as (select c_custkey, c_mktsegment as name, case when c_acctbal > 0 then (c_nationkey % 8)::varchar end as value from customer)
select c_custkey, s.name, value, fallback as "default" from s left join d on d.name = s.name where d.name is null or value is distinct from fallback""")
def config_non_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    defaults = spark.createDataFrame([("BUILDING", "3"), ("AUTOMOBILE", "7"), ("MACHINERY", None)], "name string, value string")
    value = F.when(F.col("c_acctbal") > 0, (F.col("c_nationkey") % 8).cast("string"))
    settings = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("name"), value.alias("value"))
    return catalog.differing(settings, defaults, "c_custkey", "name", "value")


@query("""with s as (select event_id, case when event_id % 3 = 0 then user_id::varchar when event_id % 3 = 1 then event_type else 'Yes' end as text, case event_type when 'click' then 'int' when 'view' then 'float' else 'bool' end as kind from events)
select event_id, coalesce(case when kind = 'int' then try_cast(text as bigint) end, -1) as whole, coalesce(case when kind = 'float' then try_cast(text as double) end, -1) as real_, coalesce(case when kind = 'bool' then case when lower(text) in ('true', 'yes', '1') then 'on' when lower(text) in ('false', 'no', '0') then 'off' end end, 'none') as flag from s""")
def config_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("event_id") % 3 == 0, F.col("user_id").cast("string")).when(F.col("event_id") % 3 == 1, F.col("event_type")).otherwise("Yes")
    kind = F.when(F.col("event_type") == "click", "int").when(F.col("event_type") == "view", "float").otherwise("bool")
    rows = read(spark, sf_dir, "events").select("event_id", catalog.coerced(text, kind).alias("x"))
    flag = F.when(F.col("x.flag"), "on").when(~F.col("x.flag"), "off").otherwise("none")
    return rows.select("event_id", F.coalesce("x.whole", F.lit(-1)).alias("whole"), F.coalesce("x.real", F.lit(-1.0)).alias("real_"), flag.alias("flag"))


@query("""select p_partkey, not p_size between 0 and 40 as prevalence, not (p_retailprice > 900 and p_retailprice <= 1800) as threshold, length(trim(p_name)) = 0 as name, (not p_size between 0 and 40)::int + (not (p_retailprice > 900 and p_retailprice <= 1800))::int + (length(trim(p_name)) = 0)::int as errors from part""")
def config_validate_tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"prevalence": ~F.col("p_size").between(0, 40), "threshold": ~((F.col("p_retailprice") > 900) & (F.col("p_retailprice") <= 1800)), "name": F.length(F.trim("p_name")) == 0}
    return naming.broken_rules(read(spark, sf_dir, "part"), "p_partkey", rules)


@query("""with expected as (select distinct user_id, t as column_ from events, (values ('click'), ('purchase'), ('seal')) k(t)) select user_id, column_ from expected e where not exists (select 1 from events a where a.user_id = e.user_id and a.event_type = e.column_)""")
def artifact_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    actual = read(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("column_"))
    expected = actual.select("user_id").distinct().select("user_id", F.explode(F.array(F.lit("click"), F.lit("purchase"), F.lit("seal"))).alias("column_"))
    return catalog.missing_columns(expected, actual, "user_id", "column_")


# ---- regions and results

@query("""with t as (select s_suppkey, 500.0 as p1, case when s_acctbal > 4000 then s_acctbal end as p2, s_acctbal from supplier) select s_suppkey, coalesce(p2, p1) as p2, s_acctbal >= coalesce(p2, p1) as keeps from t""")
def roi_second_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", F.lit(500.0).alias("p1"), F.when(F.col("s_acctbal") > 4000, F.col("s_acctbal")).alias("p2"), "s_acctbal")
    return catalog.fallback_thresholds(rows, {"p1": "p2"}).select("s_suppkey", "p2", (F.col("s_acctbal") >= F.col("p2")).alias("keeps"))


@query(f"with {MASKS}, placed as (select pixel, roi, row_number() over (partition by pixel order by roi) - 1 as layer from masks) select pixel, roi, layer from placed where layer < 3")
def roi_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.layered(supplier_masks(spark, sf_dir), "roi", "pixel", 3)


@query("""select s_suppkey, case when s_nationkey in (3, 7, 9) then 1 - (s_acctbal > 5000)::int else (s_acctbal > 5000)::int end as label from supplier""")
def roi_flip_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", (F.col("s_acctbal") > 5000).cast("int").alias("label"))
    return catalog.flipped(rows, "label", F.col("s_nationkey").isin(3, 7, 9)).select("s_suppkey", "label")


@query("""with e as (select p_brand, quantile_cont(p_retailprice, 0.01) as lo, quantile_cont(p_retailprice, 0.99) as hi from part group by p_brand)
select p_partkey, round(case when hi > lo then least(greatest((p_retailprice - lo) / (hi - lo), 0), 1) else 0 end, 6) + 0.0 as colour from part p join e on e.p_brand = p.p_brand""")
def roi_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = catalog.scaled_to_percentiles(read(spark, sf_dir, "part"), "p_brand", "p_retailprice")
    return rounded(out.select("p_partkey", "colour"), "colour", digits=6)


@query("""select quality > 0.5 as label, n_chars::double as size from labels l join documents d on d.doc_id = l.doc_id union all select toxic > 0.5, n_chars::double from labels l join documents d on d.doc_id = l.doc_id""")
def classifier_training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("size")), "doc_id")
    return catalog.training_rows(rows, "quality", ["size"]).unionByName(catalog.training_rows(rows, "toxic", ["size"]))


@query("""with n as (select l_suppkey, count(*) as frames from lineitem group by l_suppkey)
select l_suppkey, frames * 20 * 250 as most_regions, (frames // 100) * 14 + case when frames % 100 = 0 then 0 when frames % 100 > 7 then frames % 100 // 7 else 1 end as bins from n""")
def detection_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("frames"))
    return counts.select("l_suppkey", catalog.most_regions(F.col("frames"), F.lit(20)).alias("most_regions"), catalog.binned_frames(F.col("frames"), 100, 7).alias("bins"))


@query(f"""with {MOVIE}, p as (select label, pixel, avg(value) as mean, max(value) as maximum, stddev_pop(value) as deviation from movie group by all),
k as (select label, pixel, 'mean' as kind, mean as value from p union all select label, pixel, 'maximum', maximum from p union all select label, pixel, 'deviation', deviation from p)
select label, kind, count(*) as pixels, round(min(value), 4) + 0.0 as least, round(max(value), 4) + 0.0 as greatest, round(avg(value), 4) + 0.0 as mean, round(stddev_pop(value), 4) + 0.0 as deviation from k group by all""")
def detection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    planes = movie(spark, sf_dir, "label").groupBy("label", "pixel").agg(F.avg("value").alias("mean"), F.max("value").alias("maximum"), F.stddev_pop("value").alias("deviation"))
    kinds = planes.unpivot(["label", "pixel"], ["mean", "maximum", "deviation"], "kind", "value")
    sizes = kinds.groupBy("label", "kind").agg(F.count("*").alias("pixels"))
    return rounded(sizes.join(images.summary(kinds, ["label", "kind"], F.col("value")), ["label", "kind"]), "least", "greatest", "mean", "deviation")


@query(f"""with {TRACES}, whole as (select bin, sum(f) as total, count(*) as n from traces group by bin),
k as (select user_id, t.bin, f as fluorescence, case when n > 1 then (total - f) / (n - 1) else 0 end as neuropil from traces t join whole w on w.bin = t.bin),
kinds as (select user_id, bin, 'fluorescence' as kind, fluorescence as value from k union all select user_id, bin, 'neuropil', neuropil from k union all select user_id, bin, 'corrected', fluorescence - 0.7 * neuropil from k)
select user_id, bin, kind, round(value, 4) + 0.0 as value from kinds where user_id in (2, 4, 6, 10) and bin >= 0 and bin < 30 and bin % 3 = 0""")
def trace_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = temporal.neuropil_subtracted(traces(spark, sf_dir), "user_id", "bin", "f", 0.7)
    wide = out.select("user_id", "bin", F.col("f").alias("fluorescence"), ((F.col("f") - F.col("corrected")) / 0.7).alias("neuropil"), "corrected")
    kinds = wide.unpivot(["user_id", "bin"], ["fluorescence", "neuropil", "corrected"], "kind", "value")
    return rounded(temporal.read_window(kinds, "user_id", "bin", [2, 4, 6, 10], 0, 30, 3), "value")


@query("""with wanted as (select unnest(range(1990, 2001)) as recording), found as (select year(l_shipdate) as recording, count(distinct l_partkey) as regions from lineitem group by all)
select w.recording, coalesce(regions, 0) as regions, regions is null as skipped from wanted w left join found f on f.recording = w.recording""")
def recordings_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").cast("long").alias("recording")).agg(F.countDistinct("l_partkey").alias("regions"))
    joined = spark.range(1990, 2001).withColumnRenamed("id", "recording").join(found, "recording", "left")
    return joined.select("recording", F.coalesce("regions", F.lit(0)).alias("regions"), F.col("regions").isNull().alias("skipped"))


# ---- shape

CENTRES = f"""{PLACED}, m as (select roi, quantile_cont(y, 0.5) as my, quantile_cont(x, 0.5) as mx from placed group by roi),
near as (select p.roi, y, x, row_number() over (partition by p.roi order by power(y - my, 2) + power(x - mx, 2), y, x) as place from placed p join m on m.roi = p.roi),
centres as (select roi, y as cy, x as cx from near where place = 1)"""


@query(f"with {CENTRES} select roi, cy, cx from centres")
def roi_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.centres(placed_pixels(spark, sf_dir), "roi", "y", "x")


@query(f"""with {CENTRES}, r as (select p.roi, count(*) as pixels, avg(sqrt(power(y - cy, 2) + power(x - cx, 2))) as radius from placed p join centres c on c.roi = p.roi group by p.roi),
side as (select unnest(range(-40, 41)) as i), grid as (select sqrt(a.i * a.i + b.i * b.i) as d from side a, side b), placed_d as (select d, row_number() over (order by d) as k from grid),
disc as (select k, avg(d) over (order by k rows unbounded preceding) as baseline from placed_d)
select roi, pixels, round(radius, 4) + 0.0 as radius, round(greatest(1, radius / (coalesce(baseline, 2.0 / 3.0 * sqrt(pixels / pi())) + 1e-10)), 4) + 0.0 as compactness from r left join disc on k = pixels and pixels <= 4096""")
def roi_compactness_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(shape.compactness(placed_pixels(spark, sf_dir), "roi", "y", "x"), "radius", "compactness")


@query(f"""with {CENTRES}, apart as (select p.roi, sqrt(power(y - cy, 2) + power(x - cx, 2)) as d, weight from placed p join centres c on c.roi = p.roi),
whole as (select roi, floor(max(d))::bigint as last, count(*) as n from apart group by roi),
rings as (select roi, unnest(range(1, last)) as r from whole), sums as (select roi, floor(d)::bigint as r, sum(weight) as w from apart group by all),
density as (select g.roi, g.r, coalesce(w, 0) as w from rings g left join sums s on s.roi = g.roi and s.r = g.r), cut as (select roi, max(w) / 3 as cut from density group by roi),
first as (select d.roi, min(r) as first from density d join cut c on c.roi = d.roi where w > cut group by d.roi), fall as (select d.roi, min(r) as crop from density d join cut c on c.roi = d.roi join first f on f.roi = d.roi where r >= first and w < cut group by d.roi)
select a.roi, count(*) as pixels, sum((n <= 10 or coalesce(cut, 0) = 0 or d < coalesce(crop, last))::int)::bigint as soma from apart a join whole w on w.roi = a.roi left join cut c on c.roi = a.roi left join fall f on f.roi = a.roi group by a.roi""")
def roi_soma(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shape.soma(placed_pixels(spark, sf_dir), "roi", "y", "x", "weight")
    return out.groupBy("roi").agg(F.count("*").alias("pixels"), F.sum(F.col("soma").cast("int")).alias("soma"))


@query()
def roi_solidity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(shape.solidity(placed_pixels(spark, sf_dir).select("roi", "y", "x").distinct(), "roi", "y", "x"), "solidity")


# ---- extraction

BRIGHT = f"bright as {brightest_sql(0.96)}"
BUILT = f"""{BRIGHT}, single as (select *, count(*) over (partition by pixel) as holders from bright), built as (select roi, pixel, weight / sum(weight) over (partition by roi) as share from single where holders = 1)"""
SURROUND = """planes as (select distinct s_nationkey as plane, roi, pixel from bright join supplier on s_suppkey = roi),
held as (select distinct plane, pixel from planes),
inner_ as (select distinct plane, roi, y * 200 + x as pixel from (select plane, roi, pixel // 200 + dy as y, pixel % 200 + dx as x from planes, (values (0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)) s(dy, dx)) where y between 0 and 999 and x between 0 and 199),
taken as (select i.plane, i.roi, min(i.pixel // 200) as y0, max(i.pixel // 200) as y1, min(i.pixel % 200) as x0, max(i.pixel % 200) as x1, sum((h.pixel is null)::int) as taken from inner_ i left join held h on h.plane = i.plane and h.pixel = i.pixel group by all),
rounds as (select plane, roi, taken, k, greatest(y0 - 5 * k, 0) as y0, least(y1 + 5 * k, 999) as y1, greatest(x0 - 5 * k, 0) as x0, least(x1 + 5 * k, 199) as x1 from taken, (select unnest(range(1, 8)) as k)),
counts as (select r.plane, r.roi, r.k, any_value(taken) as taken, any_value((y1 - y0 + 1) * (x1 - x0 + 1)) - count(h.pixel) as free from rounds r left join held h on h.plane = r.plane and h.pixel // 200 between y0 and y1 and h.pixel % 200 between x0 and x1 group by r.plane, r.roi, r.k),
chosen as (select plane, roi, min(k) as k from counts where free - taken > 350 group by all),
rows_ as (select r.plane, r.roi, x0, x1, unnest(range(y0, y1 + 1)) as y from rounds r join chosen c on c.plane = r.plane and c.roi = r.roi and c.k = r.k),
around as (select plane, roi, y * 200 + x as pixel from (select plane, roi, y, unnest(range(x0, x1 + 1)) as x from rows_)),
surround as (select a.* from around a where not exists (select 1 from held h where h.plane = a.plane and h.pixel = a.pixel) and not exists (select 1 from inner_ i where i.plane = a.plane and i.roi = a.roi and i.pixel = a.pixel))"""


def bright_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brightest(spark, sf_dir, 0.96)


def placed_in_planes(spark: SparkSession, sf_dir: str, regions: DataFrame) -> DataFrame:
    planes = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("roi"), F.col("s_nationkey").cast("long").alias("plane"))
    return regions.join(planes, "roi")


def grown_surrounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.surrounds(placed_in_planes(spark, sf_dir, bright_regions(spark, sf_dir)), "plane", "roi", "pixel", 1000, 200, 1, 350)


@query(f"with {BUILT} select roi, pixel, round(share, 6) + 0.0 as share from built")
def mask_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(extraction.built_masks(bright_regions(spark, sf_dir), "roi", "pixel", "weight", False), "share", digits=6)


@query(f"with {BRIGHT}, {SURROUND} select plane, roi, count(*) as pixels, sum(pixel)::bigint as total from surround group by all")
def mask_surrounds_grown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grown_surrounds(spark, sf_dir).groupBy("plane", "roi").agg(F.count("*").alias("pixels"), F.sum("pixel").alias("total"))


@query(f"""with {BUILT}, {PRICES}, {SURROUND}, own as (select roi, frame, sum(share * value) as f from built b join prices p on p.pixel = b.pixel group by all),
near as (select roi, frame, avg(value) as n from surround s join prices p on p.pixel = s.pixel group by all)
select o.roi, o.frame, round(f, 3) + 0.0 as fluorescence, round(coalesce(n, 0), 3) + 0.0 as neuropil, round(f - 0.7 * coalesce(n, 0), 3) + 0.0 as corrected from own o left join near n on n.roi = o.roi and n.frame = o.frame""")
def extract_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    bright = checkpointed(bright_regions(spark, sf_dir))
    built = extraction.built_masks(bright, "roi", "pixel", "weight", False)
    around = extraction.surround_boxes(placed_in_planes(spark, sf_dir, bright), "plane", "roi", "pixel", 1000, 200, 1, 350)
    prices = monthly_prices(spark, sf_dir)
    near = extraction.surround_means(*around, prices, "plane", "roi", "pixel", "frame", "value", 1000, 200)
    return rounded(extraction.traces(built, near, prices, "roi", "pixel", "frame", "value", 0.7), "fluorescence", "neuropil", "corrected", digits=3)


@query(f"""with {OFFSETS}, near as (select *, list(y) over w as ys, list(x) over w as xs, list(correlation) over w as cs from offsets window w as (partition by plane order by frame rows between 2 preceding and 2 following)),
padded as (select *, list_sort(list_concat(ys, list_transform(range(5 - len(ys)), lambda i: 0.0::double)))[3] as my, list_sort(list_concat(xs, list_transform(range(5 - len(xs)), lambda i: 0.0::double)))[3] as mx, list_sort(list_concat(cs, list_transform(range(5 - len(cs)), lambda i: 0.0::double)))[3] as mc from near),
apart as (select *, sqrt(power(y - my, 2) + power(x - mx, 2)) as apart from padded), scaled as (select *, case when avg(apart) over (partition by plane) > 0 then apart / avg(apart) over (partition by plane) else apart end as s, coalesce(greatest(0, correlation / nullif(mc, 0)), 1) as q from apart)
select plane, frame, frame % 97 = 5 or case when q > 0 then s / q > 100 * 0.02 else s > 0 end or abs(y) > 0.95 * 0.5 * 64 or abs(x) > 0.95 * 0.5 * 64 as bad from scaled""")
def frame_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = offsets(spark, sf_dir).withColumn("listed", F.col("frame") % 97 == 5)
    return extraction.crop(rows, "plane", "frame", "y", "x", "correlation", "listed", 0.02, 0.5, 64, 64, 2)


# ---- alignment, classification by grids, tracking rules

SEGMENTS = """pairs as (select c_custkey as key, (c_mktsegment = 'BUILDING')::int as label, unnest(['balance', 'nation']) as feature, unnest([c_acctbal::double, c_nationkey::double]) as value from customer),
ranked as (select *, row_number() over (partition by feature order by value, key) - 1 as k, count(*) over (partition by feature) as n from pairs),
bins as (select feature, (99 * (k + 1) - 1) // (n - 1) as bin, avg(label) as share, min(value) as node from ranked where k < n - 1 group by all),
weights as (select d, exp(-d * d / 8.0) / (select sum(exp(-e * e / 8.0)) from range(-8, 9) r(e)) as w from range(-8, 9) q(d)),
grid as (select b.feature, b.bin, b.node, sum(w * o.share) as share from bins b, weights, bins o
    where o.feature = b.feature and o.bin = case when b.bin + d < 0 then -1 - b.bin - d when b.bin + d > 98 then 197 - b.bin - d else b.bin + d end group by all)"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = (F.col("c_mktsegment") == "BUILDING").cast("int").alias("label")
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), label, F.col("c_acctbal").cast("double").alias("balance"), F.col("c_nationkey").cast("double").alias("nation"))


@query(f"with {SEGMENTS} select feature, bin, round(node, 4) + 0.0 as node, round(share, 6) + 0.0 as share from grid")
def class_grid_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = classifier.probability_grid(segments(spark, sf_dir), "key", "label", ["balance", "nation"])
    out = grid.select("feature", F.inline("grid")).where("share is not null")
    return rounded(rounded(out, "node"), "share", digits=6)


@query(f"""with {SEGMENTS}, tops as (select feature, max(value) as top from pairs group by feature),
nodes as (select feature, node from grid union all select feature, top from tops),
rows_ as (select s_suppkey as key, unnest(['balance', 'nation']) as feature, unnest([s_acctbal::double, s_nationkey::double]) as value from supplier),
placed as (select r.key, r.feature, greatest(least(count(*) filter (where node < least(value, top)), 99) - 1, 0) as bin from rows_ r join tops t on t.feature = r.feature join nodes n on n.feature = r.feature group by r.key, r.feature)
select key, p.feature, round(ln(share + 1e-6) - ln(1 - share + 1e-6), 4) + 0.0 as odds from placed p join grid g on g.feature = p.feature and g.bin = p.bin""")
def class_grid_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"))
    grid = classifier.probability_grid(segments(spark, sf_dir), "key", "label", ["balance", "nation"])
    return rounded(classifier.grid_log_odds(rows, grid, "key", ["balance", "nation"]), "odds")


@query()
def class_grid_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"))
    return rounded(classifier.classified(rows, segments(spark, sf_dir), "key", "label", ["balance", "nation"]), "probability")


CENTRES = "centres as (select c_custkey as roi, c_nationkey % 5 as recording, c_custkey * 37 % 1000 as y, c_custkey * 91 % 1000 as x from customer)"
REACHED = f"""{CENTRES}, reached as (select c.*, b.k as "by", d.k as bx from centres c, range(10) b(k), range(10) d(k)
    where y > b.k * 100 - 20 and y < b.k * 100 + 120 and x > d.k * 100 - 20 and x < d.k * 100 + 120)"""


def reached_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    centres = read(spark, sf_dir, "customer").select(key.alias("roi"), (F.col("c_nationkey") % 5).alias("recording"), (key * 37 % 1000).alias("y"), (key * 91 % 1000).alias("x"))
    return tracking.in_bins(centres, "y", "x", 100, 20, 1000, 1000)


@query(f"with {REACHED} select * from reached")
def tracking_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reached_bins(spark, sf_dir)


@query(f"""with {REACHED}, members as (select *, roi % 3 as cluster from reached),
kept as (select "by", bx, cluster from members group by all having count(distinct recording) >= 2 and avg(y) >= "by" * 100 and avg(y) < "by" * 100 + 100 and avg(x) >= bx * 100 and avg(x) < bx * 100 + 100),
ranked as (select m.roi, m."by", m.bx, m.cluster, row_number() over (partition by m.roi order by m."by", m.bx, m.cluster) as place from members m join kept k on k."by" = m."by" and k.bx = m.bx and k.cluster = m.cluster)
select "by", bx, cluster, roi from ranked where place = 1""")
def tracking_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking.accepted(reached_bins(spark, sf_dir).withColumn("cluster", F.col("roi") % 3), 100, 2)


@query("""with regions as (select l_suppkey as roi, l_partkey as pixel, sum(l_quantity)::double as weight from lineitem group by all),
field as (select p_partkey as target, floor(p_partkey // 100 + (p_size % 5 - 2) * 0.6::double + 0.5) as y, floor(p_partkey % 100 + (p_partkey % 7 - 3) * 0.7::double + 0.5) as x from part)
select roi, target as pixel, round(weight, 4) + 0.0 as weight from regions r join field f on r.pixel = (y * 100 + x)::bigint where y between 0 and 999 and x between 0 and 99""")
def mask_moved_by_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("roi"), F.col("l_partkey").alias("pixel")).agg(F.sum("l_quantity").cast("double").alias("weight"))
    offsets = [((F.col("p_size") % 5 - 2) * 0.6).alias("dy"), ((F.col("p_partkey") % 7 - 3) * 0.7).alias("dx")]
    field = read(spark, sf_dir, "part").select(F.lit(0).alias("recording"), F.col("p_partkey").alias("pixel"), *offsets)
    out = masks.moved_by_field(lines.withColumn("recording", F.lit(0)), field, "recording", 1000, 100)
    return rounded(out.drop("recording"), "weight")


def plane_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = temporal.numbered(read(spark, sf_dir, "embeddings"), "label", "vec_id")
    return alignment.reference_images(rows, "label", "frame", "embedding", 8, 8, 2, 1.0, 1.0, most=200)


@query()
def frame_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plane_references(spark, sf_dir).select("label", F.transform("reference", lambda v: F.round(v, 4)).alias("reference"))


@query()
def frame_line_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.line_phases(read(spark, sf_dir, "embeddings"), "label", "embedding", 8, 8)


@query()
def frame_block_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = alignment.Grid.over(8, 8, 6, 6)
    return alignment.block_offsets(read(spark, sf_dir, "embeddings"), plane_references(spark, sf_dir), "label", "vec_id", "embedding", 8, 8, grid, 2.0, 1.0, 1.0, around=1)


@query()
def frame_nonrigid(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = alignment.Grid.over(8, 8, 6, 6)
    return alignment.corrected(read(spark, sf_dir, "embeddings"), plane_references(spark, sf_dir), "label", "vec_id", "embedding", 8, 8, grid, 2.0, 1.0, 1.0, around=1)
