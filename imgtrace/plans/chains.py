"""Queries over whole chains of steps: registration, tracking, extraction; with SQL where it can express them.

Shapes as in the catalogue: movies are embeddings (plane label, frames in order of vec_id, 8 by 8 pixels).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from imgtrace.functions import temporal
from imgtrace.operators import alignment, deconvolution, extraction, fields, fluorescence, frames, masks, movies, principal, registration, settings, shape, tracking
from imgtrace.operators.graphs import checkpointed
from imgtrace.plans.catalogue import MOVIE, TRACES, brightest, brightest_sql, numbered_traces, query, ranked_events, read, rounded, smoothed_sql, supplier_masks
from imgtrace.sources import tiff
from imgtrace.streaming import traces as streams
from imgtrace.streaming import windows

# ---- registration

STEPS = registration.Steps(8, 8, reach=2, sigma=1.0, slope=1.0, in_time=1.0)
CHAIN = registration.Steps(8, 8, reach=2, sigma=1.0, slope=1.0, in_time=1.0, grid=alignment.Grid.over(8, 8, 6, 6), most=2.0, around=1)


def numbered_movie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.numbered(read(spark, sf_dir, "embeddings").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("embedding")), "label", "vec_id")


def mean_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.mean_images(read(spark, sf_dir, "embeddings"), ["label"], "embedding").withColumnRenamed("pixels", "reference")


#: Correlation by Fourier sums over all pixels and waves; WEIGHTS stands for the smoothing over frames.
RIGID = f"""with {MOVIE}, numbered as (select label, dense_rank() over (partition by label order by frame) - 1 as frame, pixel, value::double as v from movie),
n as (select label, max(frame) + 1 as n from numbered group by label),
mean_image as (select label, pixel, avg(v) as v from numbered group by all),
edges as (select label, quantile_cont(v, 0.01) as lo, quantile_cont(v, 0.99) as hi from mean_image group by label),
clipped as (select label, pixel, least(greatest(v, lo), hi) as v from mean_image join edges using (label)),
middle as (select label, avg(v) as m from clipped group by label),
mask as (select i as pixel, 1 / (1 + exp(abs(i // 8 - 3.5::double) - 1.5)) / (1 + exp(abs(i % 8 - 3.5::double) - 1.5)) as w from (select unnest(range(64)) as i)),
faded as (select f.label, f.frame, f.pixel, least(greatest(v, lo), hi) * w + m * (1 - w) as v from numbered f join edges using (label) join middle using (label) join mask using (pixel)),
waves as (select u, i as pixel, cos(2 * pi() * ((u // 8) * (i // 8) + (u % 8) * (i % 8)) / 8) as c, sin(2 * pi() * ((u // 8) * (i // 8) + (u % 8) * (i % 8)) / 8) as s
  from (select unnest(range(64)) as u), (select unnest(range(64)) as i)),
bell as (select k, sum(exp(-0.5::double * d * d) * cos(2 * pi() * k * d / 8)) / sum(exp(-0.5::double * d * d)) as g from (select unnest(range(8)) as k), (select unnest(range(-4, 4)) as d) group by k),
held as (select label, u, sum(v * c) as re, -sum(v * s) as im from clipped join waves using (pixel) group by all),
held_white as (select label, u, a.g * b.g * re / (sqrt(re * re + im * im) + 1e-5) as re, -a.g * b.g * im / (sqrt(re * re + im * im) + 1e-5) as im from held join bell a on a.k = u // 8 join bell b on b.k = u % 8),
seen as (select label, frame, u, sum(v * c) as re, -sum(v * s) as im from faded join waves using (pixel) group by all),
product as (select f.label, f.frame, f.u, (f.re * h.re - f.im * h.im) / (sqrt(f.re * f.re + f.im * f.im) + 1e-5) as re, (f.re * h.im + f.im * h.re) / (sqrt(f.re * f.re + f.im * f.im) + 1e-5) as im from seen f join held_white h on h.label = f.label and h.u = f.u),
shifts as (select sy, sx, u, cos(2 * pi() * ((u // 8) * sy + (u % 8) * sx) / 8) as c, sin(2 * pi() * ((u // 8) * sy + (u % 8) * sx) / 8) as s
  from (select unnest(range(-2, 3)) as sy), (select unnest(range(-2, 3)) as sx), (select unnest(range(64)) as u)),
surface as (select label, frame, sy, sx, sum(re * c - im * s) / 64 as v from product join shifts using (u) group by all),
weights as (WEIGHTS),
wanted as (select label, frame, w, case when spot < n then spot else 2 * n - 1 - spot end as other from (select label, f.frame, n, w, (f.frame + k + 8 * n) % (2 * n) as spot from (select distinct label, frame from numbered) f join n using (label), weights)),
smooth as (select a.label, a.frame, s.sy, s.sx, sum(w * s.v) as v from wanted a join surface s on s.label = a.label and s.frame = a.other group by all),
ranked as (select *, row_number() over (partition by label, frame order by v desc, sy, sx) as place from smooth)
select label as plane, frame, sy as dy, sx as dx, round(v, 4) + 0.0 as correlation from ranked where place = 1"""


@query(RIGID.replace("WEIGHTS", "select k, exp(-0.5::double * k * k) / sum(exp(-0.5::double * k * k)) over () as w from (select unnest(range(-4, 5)) as k)"))
def registration_rigid(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = registration.rigid_offsets(numbered_movie(spark, sf_dir), mean_references(spark, sf_dir), "label", "frame", "embedding", STEPS)
    return rounded(out, "correlation")


@query(RIGID.replace("WEIGHTS", "select 0 as k, 1.0::double as w"))
def frame_registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame by itself."""
    out = registration.rigid_offsets(numbered_movie(spark, sf_dir), mean_references(spark, sf_dir), "label", "frame", "embedding", replace(STEPS, in_time=0.0))
    return rounded(out, "correlation")


@query()
def registration_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rigid offsets, blocks, and a second channel (the frame upside down) moved the same way."""
    both = numbered_movie(spark, sf_dir).withColumn("second", F.reverse("embedding"))
    return registration.register(both, mean_references(spark, sf_dir), "label", "frame", "embedding", CHAIN, second="second")


# ---- tracking

GREEDY = """with recursive rows as (select distinct s_nationkey as plane, l_suppkey as roi, l_partkey as pixel from lineitem join supplier on s_suppkey = l_suppkey),
held as (select plane, pixel, list(roi) as rois from rows group by all),
cells as (select r.plane, r.roi, list({'lower': len(list_filter(rois, lambda x: x < r.roi)) > 0, 'higher': list_filter(rois, lambda x: x > r.roi)}) as own from rows r join held h on h.plane = r.plane and h.pixel = r.pixel group by all),
turns as (select *, row_number() over (partition by plane order by roi desc) as turn from cells),
walk as (
  select distinct plane, 0::bigint as turn, []::bigint[] as gone from rows
  union all
  select w.plane, t.turn, case when len(list_filter(t.own, lambda c: c.lower or len(list_filter(c.higher, lambda x: not list_contains(w.gone, x))) > 0)) > 0.2 * len(t.own) then list_append(w.gone, t.roi) else w.gone end
  from walk w join turns t on t.plane = w.plane and t.turn = w.turn + 1),
last as (select plane, arg_max(gone, turn) as gone from walk group by plane)
select t.plane, t.roi from turns t join last l on l.plane = t.plane where not list_contains(gone, roi)"""


@query(GREEDY)
def roi_greedy_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    planes = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("roi"), F.col("s_nationkey").alias("plane"))
    return tracking.without_overlapping(supplier_masks(spark, sf_dir).join(planes, "roi"), "plane", "roi", "pixel", 0.2)


def yearly_regions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Regions are suppliers in each year (the recording), near a place of the supplier's own; their masks the years' parts."""
    lines = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", F.year("l_shipdate").alias("year"), "l_quantity")
    roi = (F.col("l_suppkey") * 10 + F.col("year") % 10).cast("long")
    place = lambda k: (F.col("l_suppkey") * k % 1000 + F.col("year") % 5).cast("double")
    regions = lines.select(roi.alias("roi"), F.col("year").cast("long").alias("recording"), place(37).alias("y"), place(91).alias("x")).distinct()
    pixel = F.floor(F.col("l_suppkey") / 2) * 1_000_000 + F.col("l_partkey")  # shared by two suppliers only
    return regions, lines.groupBy(roi.alias("roi"), pixel.cast("long").alias("pixel")).agg(F.sum("l_quantity").cast("double").alias("weight"))


@query()
def tracking_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions, held = yearly_regions(spark, sf_dir)
    return tracking.tracked(regions, held, 100, 20, 12.0, 0.97, 2, 1000, 1000)


@query()
def tracking_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions, held = yearly_regions(spark, sf_dir)
    return tracking.templates(tracking.tracked(regions, held, 100, 20, 12.0, 0.97, 2, 1000, 1000), held, 50, 1)


# ---- motion left after registration


@query()
def pc_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(principal.scores(numbered_movie(spark, sf_dir), "label", "frame", "embedding", 3), "score", "share", digits=6)


@query()
def pc_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(principal.metrics(numbered_movie(spark, sf_dir), "label", "frame", "embedding", CHAIN, 3, 10), "share", "rigid", "blocks_mean", "blocks_most")


# ---- streams of traces


def arriving(spark: SparkSession, table: DataFrame, cuts: tuple[int, ...]) -> list[DataFrame]:
    """A table of region, frame and value as tables that arrive one after the other; the last one ends all regions.

    Each part reads the table, so it must be one that is not made anew each time."""
    ends = (0, *cuts)
    parts = [table.where((F.col("frame") >= low) & (F.col("frame") < high)) for low, high in zip(ends, cuts, strict=False)]
    none = F.lit(None)
    last = table.where(F.col("frame") >= cuts[-1]).unionByName(table.select("region").distinct().select("region", none.cast("long").alias("frame"), none.cast("double").alias("value")))
    return [*parts, last]


@query(f"""with {TRACES}, {smoothed_sql(1.0, 3)}, low as (select *, min(s) over (partition by user_id order by frame rows between 3 preceding and 3 following) as low from smooth)
select user_id as region, frame, round(max(low) over (partition by user_id order by frame rows between 3 preceding and 3 following), 4) + 0.0 as baseline from low""")
def stream_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = checkpointed(numbered_traces(spark, sf_dir).select(F.col("user_id").cast("long").alias("region"), F.col("frame").cast("long").alias("frame"), F.col("f").alias("value")))
    out = streams.in_turns(spark, windows.shared_folder(spark), arriving(spark, table, (20, 45)), lambda s: streams.baselines(s, "region", "frame", "value", 1.0, 3, 3))
    return rounded(out.drop("value"), "baseline")


@query()
def stream_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = checkpointed(ranked_events(spark, sf_dir).select(F.col("user_id").cast("long").alias("region"), F.col("frame").cast("long").alias("frame"), F.col("value").cast("double").alias("value")))
    least = table.agg(F.min("value")).first()[0] or 0.0
    return streams.in_turns(spark, windows.shared_folder(spark), arriving(spark, table, (20, 45)), lambda s: streams.spikes(s, "region", "frame", "value", 0.7, 10.0, least))


# ---- extraction

#: Regions are nations, in planes by number; their pixels are those that get most of the nation's parts, by number of part.
REGIONS = """regions as (select s_nationkey as roi, s_nationkey % 10 as plane, l_partkey % 64 as pixel, sum(l_quantity)::double as weight from lineitem join supplier on s_suppkey = l_suppkey group by all),
masks as (select * from regions qualify weight >= quantile_cont(weight, 0.9) over (partition by roi)),
every as (select distinct plane, roi from masks),
built as (select plane, roi, pixel, weight / sum(weight) over (partition by plane, roi) as share from masks),
held as (select distinct plane, pixel from masks),
grown as (select plane, roi, pixel // 8 + dy as y, pixel % 8 + dx as x from masks, (values (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) as steps(dy, dx)),
around as (select plane, roi, i as pixel from every e, (select unnest(range(64)) as i) where not exists (select 1 from held h where h.plane = e.plane and h.pixel = i)
  and not exists (select 1 from grown g where g.plane = e.plane and g.roi = e.roi and g.y = i // 8 and g.x = i % 8))"""
FOUND = f"""{MOVIE}, numbered as (select label as plane, dense_rank() over (partition by label order by frame) - 1 as frame, pixel, value from movie), {REGIONS},
own as (select plane, roi, frame, sum(share * value) as fluorescence from built join numbered using (plane, pixel) group by all),
near as (select plane, roi, frame, avg(value) as neuropil from around join numbered using (plane, pixel) group by all),
found as (select plane, roi, frame, fluorescence, coalesce(neuropil, 0) as neuropil, fluorescence - 0.7::double * coalesce(neuropil, 0) as corrected from own left join near using (plane, roi, frame))"""


def regions_of_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    nation = F.col("s_nationkey").cast("long")
    whole = lines.groupBy(nation.alias("roi"), (nation % 10).alias("plane"), (F.col("l_partkey") % 64).cast("long").alias("pixel")).agg(F.sum("l_quantity").cast("double").alias("weight"))
    most = F.percentile("weight", F.lit(0.9)).over(Window.partitionBy("roi"))
    return whole.withColumn("most", most).where("weight >= most").drop("most")


def masks_of_planes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Masks with shared pixels, and surrounds that take all free pixels of the plane but the region's own border."""
    regions = regions_of_planes(spark, sf_dir)
    share = F.col("weight") / F.sum("weight").over(Window.partitionBy("plane", "roi"))
    return regions.select("plane", "roi", "pixel", share.alias("share")), extraction.surrounds(regions, "plane", "roi", "pixel", 8, 8, 1, 64)


def extracted(spark: SparkSession, sf_dir: str, second: bool = False) -> DataFrame:
    movie = numbered_movie(spark, sf_dir)
    movie = movie.withColumn("embedding", F.reverse("embedding")) if second else movie
    return fluorescence.traces(movie, *masks_of_planes(spark, sf_dir), "label", "frame", "embedding", 8, 8, 0.7)


@query(f"""with {FOUND} select plane, roi, frame, round(fluorescence, 5) + 0.0 as fluorescence, round(neuropil, 5) + 0.0 as neuropil, round(corrected, 5) + 0.0 as corrected,
round(corrected - quantile_cont(corrected, 0.08) over (partition by plane, roi), 5) + 0.0 as delta from found""")
def extraction_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fluorescence.with_baseline(extracted(spark, sf_dir), 0.08)
    return rounded(out, "fluorescence", "neuropil", "corrected", "delta", digits=5)


@query(f"""with {FOUND}, centred as (select *, corrected - avg(corrected) over (partition by plane, roi) as c from found)
select plane, roi, count(*) as frames, round(avg(corrected), 5) + 0.0 as mean, round(stddev_pop(corrected), 5) + 0.0 as deviation, round(avg(c * c * c) / power(avg(c * c), 1.5), 5) + 0.0 as skewness from centred group by all""")
def extraction_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fluorescence.activity(extracted(spark, sf_dir)), "mean", "deviation", "skewness", digits=5)


@query()
def extraction_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spikes of each region's corrected trace less its baseline."""
    deltas = fluorescence.with_baseline(extracted(spark, sf_dir), 0.08).withColumn("region", F.col("plane") * 1000 + F.col("roi"))
    return rounded(deconvolution.spikes(deltas, "region", "frame", "delta", 0.7, 10.0), "spike", digits=6)


BLENDED = f"""with {FOUND}, means as (select plane, pixel, avg(value) as f from numbered group by all),
images as (select a.plane, a.pixel, a.f, b.f as s, a.pixel // 8 as y, a.pixel % 8 as x from means a join means b on b.plane = a.plane and b.pixel = 63 - a.pixel),
bounds as (select unnest(range(3)) as b, unnest([0, 2, 5]) as low, unnest([2, 5, 8]) as high),
bell as (select k, exp(-0.5::double * k * k) / sum(exp(-0.5::double * k * k)) over () as w from (select unnest(range(-4, 5)) as k)),
side as (select b, i, sum(w) as w from bounds, bell, (select unnest(range(8)) as i) where case when (i + k + 16) % 16 < 8 then (i + k + 16) % 16 else 15 - (i + k + 16) % 16 end between low and high - 1 group by all),
slopes as (select plane, v.b as by_, h.b as bx, case when sum(f * f) > 0 then sum(f * s) / sum(f * f) else 0 end as slope from images join bounds v on y between v.low and v.high - 1 join bounds h on x between h.low and h.high - 1 group by all),
blend as (select i.plane, i.pixel, any_value(f) as f, any_value(s) as s, sum(v.w * h.w * slope) as blend from images i join slopes p on p.plane = i.plane join side v on v.b = by_ and v.i = i.y join side h on h.b = bx and h.i = i.x group by all),
fixed as (select plane, pixel, greatest(0, s - f * blend) as value from blend)"""


def second_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean images of the first channel and of the second (the frames upside down), and the second without bleedthrough."""
    movie = read(spark, sf_dir, "embeddings").withColumn("other", F.reverse("embedding"))
    first = frames.mean_images(movie, ["label"], "embedding").select(F.col("label").alias("plane"), F.col("pixels").alias("functional"))
    second = frames.mean_images(movie, ["label"], "other").select(F.col("label").alias("plane"), F.col("pixels").alias("structural"))
    return fluorescence.corrected_images(first.join(second, "plane"), 8, 8)


@query(f"{BLENDED} select plane, pixel, round(value, 6) + 0.0 as value from fixed")
def image_bleedthrough_blended(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = second_images(spark, sf_dir).select("plane", F.posexplode("pixels").alias("pixel", "value"))
    return rounded(pixels.withColumn("pixel", F.col("pixel").cast("long")), "value", digits=6)


@query(f"""{BLENDED}, inside as (select plane, roi, greatest(1e-3, sum(share * value)) as inside from built join fixed using (plane, pixel) group by all),
outside as (select plane, roi, avg(value) as outside from around join fixed using (plane, pixel) group by all),
trace as (select plane, roi, avg(share_value) as mean from (select plane, roi, frame, sum(share * value) as share_value from built b join (select plane, frame, 63 - pixel as pixel, value from numbered) using (plane, pixel) group by all) group by all)
select plane, roi, round(mean, 5) + 0.0 as mean, round(inside, 5) + 0.0 as inside, round(coalesce(outside, 0), 5) + 0.0 as outside, round(inside / (inside + coalesce(outside, 0)), 5) + 0.0 as probability, inside / (inside + coalesce(outside, 0)) > 0.65 as colocalized
from inside join trace using (plane, roi) left join outside using (plane, roi)""")
def channel_2_structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first channel's masks on the second channel: mean fluorescence, and whether the corrected image is bright under them."""
    means = extracted(spark, sf_dir, second=True).groupBy("plane", "roi").agg(F.avg("fluorescence").alias("mean"))
    met = fluorescence.colocalized(*masks_of_planes(spark, sf_dir), second_images(spark, sf_dir), 0.65)
    return rounded(means.join(met, ["plane", "roi"]), "mean", "inside", "outside", "probability", digits=5)


@query(f"""with {FOUND}, moved as (select plane, roi + 100 as roi, 63 - pixel as pixel, share from built), placed as (select plane, roi, frame, sum(share * value) as f from moved join (select plane, frame, 63 - pixel as pixel, value from numbered) using (plane, pixel) group by all),
centred as (select *, f - avg(f) over (partition by plane, roi) as c from placed),
stats as (select plane, roi, count(*) as frames, avg(f) as mean, avg(c * c * c) / power(avg(c * c), 1.5) as skewness from centred group by all),
a as (select plane, roi, pixel, count(*) over (partition by plane, roi) as n from built), b as (select plane, roi, pixel, count(*) over (partition by plane, roi) as n from moved),
score as (select b.plane, b.roi, a.roi as other, count(*) / least(any_value(a.n), any_value(b.n))::double as score from a join b on a.plane = b.plane and a.pixel = b.pixel group by all),
best as (select *, row_number() over (partition by plane, roi order by score desc, other) as r1, row_number() over (partition by plane, other order by score desc, roi) as r2 from score)
select s.plane, s.roi, frames, round(mean, 5) + 0.0 as mean, round(skewness, 5) + 0.0 as skewness, coalesce(other, -1) as matched, round(coalesce(score, 0), 5) + 0.0 as score
from stats s left join best b on b.plane = s.plane and b.roi = s.roi and r1 = 1 and r2 = 1 and score >= 0.1""")
def channel_2_functional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second channel's own masks: their traces on it, and the first channel's regions that they match best."""
    built, _ = masks_of_planes(spark, sf_dir)
    second = built.select("plane", (F.col("roi") + 100).alias("roi"), (63 - F.col("pixel")).alias("pixel"), "share")
    movie = numbered_movie(spark, sf_dir).withColumn("embedding", F.reverse("embedding"))
    found = fluorescence.traces(movie, second, second.limit(0), "label", "frame", "embedding", 8, 8, 0.0)
    by_plane = lambda m: m.select(F.col("roi"), (F.col("plane") * 64 + F.col("pixel")).alias("pixel"))
    matches = masks.mutual_matches(by_plane(second), by_plane(built), "roi", "pixel", 0.1).withColumnRenamed("a", "roi")
    out = fluorescence.activity(found).drop("deviation").join(matches, "roi")
    return rounded(out.select("plane", "roi", "frames", "mean", "skewness", "matched", "score"), "mean", "skewness", "score", digits=5)


# ---- stacks of pages


@query("""with pages as (select vec_id as position, count(*) over () as n, unnest(range(64)) as pixel, trunc(unnest(embedding)::double * 10000)::integer as value from embeddings)
select position % 4 // 2 as plane, position % 2 as channel, position // 4 as frame, pixel, value from pages where position < n // 4 * 4""")
def tiff_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The movie written as stacks of pages, read again, and dealt to two planes of two channels."""
    folder = f"{re.sub('^file:/+', '/', windows.shared_folder(spark))}/imgtrace-stacks-{uuid.uuid4().hex}"
    values = F.transform("embedding", lambda v: (v.cast("double") * 10000).cast("int").cast("smallint"))
    movie = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("frame"), F.lit(8).alias("height"), F.lit(8).alias("width"), values.alias("pixels"))
    for source in (tiff.TiffPages, tiff.TiffStack):
        spark.dataSource.register(source)
    movie.repartitionByRange("frame").sortWithinPartitions("frame").write.format("tiff_stack").mode("append").save(folder)
    pages = spark.read.format("tiff_pages").load(folder)
    return tiff.converted(pages, 2, 2).select("plane", "channel", "frame", F.posexplode("pixels").alias("pixel", "value")).withColumns({"pixel": F.col("pixel").cast("long"), "value": F.col("value").cast("int")})


# ---- masks between recordings

#: Regions of the world are recordings, each with a smooth field of its own over 40 by 50 pixels.
FIELDS = """fields as (select r_regionkey as recording, i as pixel, 2 * sin(i // 50 / 12.0::double + r_regionkey) as dy, 1.5::double * cos(i % 50 / 10.0::double - r_regionkey) as dx from region, (select unnest(range(2000)) as i)),
placed as (select n_regionkey as recording, l_suppkey as roi, l_partkey % 2000 as pixel, sum(l_quantity)::double as weight from lineitem join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey group by all)"""


def smooth_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = F.sequence(F.lit(0), F.lit(1999))
    key = F.col("r_regionkey")
    dy = F.transform(grid, lambda i: 2 * F.sin(F.floor(i / 50) / 12.0 + key))
    dx = F.transform(grid, lambda i: 1.5 * F.cos(i % 50 / 10.0 - key))
    return read(spark, sf_dir, "region").select(key.cast("long").alias("recording"), dy.alias("dy"), dx.alias("dx"))


def placed_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    homes = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_regionkey")
    lines = read(spark, sf_dir, "lineitem").join(homes, F.col("s_suppkey") == F.col("l_suppkey"))
    keys = [F.col("n_regionkey").cast("long").alias("recording"), F.col("l_suppkey").cast("long").alias("roi"), (F.col("l_partkey") % 2000).cast("long").alias("pixel")]
    return lines.groupBy(*keys).agg(F.sum("l_quantity").cast("double").alias("weight"))


@query(f"""with {FIELDS}, aimed as (select recording, pixel as target, floor(pixel // 50 + dy + 0.5::double) as y, floor(pixel % 50 + dx + 0.5::double) as x from fields)
select p.recording, roi, target as pixel, weight from placed p join aimed a on a.recording = p.recording and a.y between 0 and 39 and a.x between 0 and 49 and p.pixel = (a.y * 50 + a.x)::bigint""")
def masks_into_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.into_common(placed_regions(spark, sf_dir), smooth_fields(spark, sf_dir), 40, 50)


@query()
def masks_into_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region's mask, taken into the common view from its own recording, as all recordings see it; by counts and middles."""
    moving = smooth_fields(spark, sf_dir)
    common = fields.into_common(placed_regions(spark, sf_dir), moving, 40, 50).select(F.col("roi").alias("cluster"), "pixel", "weight")
    return rounded(fields.summary(fields.into_recordings(common, moving, 40, 50), "cluster", 50), "radius")


# ---- windows over pixels and frames


def around_sql(before: int, after: int) -> str:
    """frame, pixel, value, total and n over the square from `before` pixels before to `after` behind."""
    near = lambda axis: f"b.pixel {axis} 8 - a.pixel {axis} 8 between -{before} and {after}"
    return f"(select a.frame, a.pixel, any_value(a.value) as value, sum(b.value) as total, count(*) as n from movie a join movie b on b.frame = a.frame and {near('//')} and {near('%')} group by all)"


def filtered_movie(spark: SparkSession, sf_dir: str, kernel: Callable[[np.ndarray], np.ndarray], name: str) -> DataFrame:
    out = frames.per_frame(read(spark, sf_dir, "embeddings"), "embedding", 8, 8, lambda x, _: kernel(x), ["vec_id"])
    return frames.as_pixels(out.withColumnRenamed("vec_id", "frame"), "frame").withColumnRenamed("value", name)


@query(f"with {MOVIE} select frame, pixel, round(total / 16, 5) + 0.0 as smoothed from {around_sql(1, 2)}")
def image_even_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(filtered_movie(spark, sf_dir, lambda x: frames.smoothed(x, 4), "smoothed"), "smoothed", digits=5)


@query(f"with {MOVIE} select frame, pixel, round(value - total / n, 5) + 0.0 as passed from {around_sql(1, 2)}")
def image_even_highpass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(filtered_movie(spark, sf_dir, lambda x: frames.high_passed(x, 4), "passed"), "passed", digits=5)


@query(f"with {MOVIE} select frame, pixel, round(value - total / n, 5) + 0.0 as passed from {around_sql(2, 1)}")
def image_without_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(filtered_movie(spark, sf_dir, lambda x: frames.without_background(x, 4), "passed"), "passed", digits=5)


@query(f"with {MOVIE} select frame, pixel, round(total / 3, 5) + 0.0 as response from {around_sql(1, 1)}")
def image_square_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(filtered_movie(spark, sf_dir, lambda x: frames.square_response(x, 3), "response"), "response", digits=5)


@query(f"with {TRACES}, {smoothed_sql(2.0, 8)} select user_id, bin, round(f - s, 5) + 0.0 as passed from smooth")
def trace_gaussian_highpass(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = movies.high_pass(numbered_traces(spark, sf_dir), "user_id", "frame", "f", 2)
    return rounded(out.select("user_id", "bin", "passed"), "passed", digits=5)


# ---- statistics of regions


STATISTICS = f"""with marks as {brightest_sql(0.96)}, placed as (select s_nationkey as plane, roi, pixel // 100 as y, pixel % 100 as x, pixel, weight from marks join supplier on s_suppkey = roi),
m as (select roi, quantile_cont(y, 0.5) as my, quantile_cont(x, 0.5) as mx, count(*) as n from placed group by roi),
near as (select p.roi, y, x, row_number() over (partition by p.roi order by power(y - my, 2) + power(x - mx, 2), y, x) as place from placed p join m using (roi)),
grid as (select sqrt(a.i * a.i + b.i * b.i) as d from (select unnest(range(-20, 21)) as i) a, (select unnest(range(-20, 21)) as i) b),
disc as (select row_number() over (order by d) as k, avg(d) over (order by d rows unbounded preceding) as baseline from grid),
spread as (select p.roi, any_value(n) as n, avg(sqrt(power(y - my, 2) + power(x - mx, 2))) as r from placed p join m using (roi) group by p.roi),
sums as (select roi, sum(weight) as w, sum(weight * y) as wy, sum(weight * x) as wx, sum(weight * y * y) as wyy, sum(weight * x * x) as wxx, sum(weight * y * x) as wyx from placed group by roi),
moments as (select roi, (wyy / w - power(wy / w, 2)) / 100 as a, (wxx / w - power(wx / w, 2)) / 100 as b, (wyx / w - wy / w * wx / w) / 100 as c from sums),
radii as (select roi, 2.5 * sqrt(greatest((a + b) / 2 + sqrt(power((a - b) / 2, 2) + c * c), 0)) as major, 2.5 * sqrt(greatest((a + b) / 2 - sqrt(power((a - b) / 2, 2) + c * c), 0)) as minor from moments),
counts as (select plane, roi, count(*) as pixels from placed group by all),
sizes as (select *, row_number() over (partition by plane order by roi) as place from counts),
usual as (select plane, avg(pixels) as mean from sizes where place <= 100 group by plane),
shared as (select roi, sum((holders > 1)::int)::bigint as overlapping from (select roi, count(*) over (partition by plane, pixel) as holders from placed) group by roi)
select s.plane, s.roi, s.pixels, round(s.pixels / mean, 4) + 0.0 as normalized, near.y as cy, near.x as cx, round(greatest(1, r / (baseline + 1e-9)), 4) + 0.0 as compactness, round(major * 10, 4) + 0.0 as radius, round(2 * major / (major + minor + 0.01), 4) + 0.0 as aspect_ratio, overlapping
from sizes s join usual using (plane) join near on near.roi = s.roi and near.place = 1 join spread on spread.roi = s.roi join disc on k = least(n, 1681) join radii on radii.roi = s.roi join shared on shared.roi = s.roi"""


@query(STATISTICS)
def roi_statistics_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    planes = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("roi"), F.col("s_nationkey").alias("plane"))
    placed = brightest(spark, sf_dir, 0.96).join(planes, "roi").select("plane", "roi", F.floor(F.col("pixel") / 100).alias("y"), (F.col("pixel") % 100).alias("x"), "weight")
    return rounded(shape.statistics(placed, 100, crop=False).drop("soma_pixels", "solidity"), "normalized", "compactness", "radius", "aspect_ratio")


# ---- settings and readiness


def _literal(x: object) -> str:
    return "null" if x is None else f"'{x}'" if isinstance(x, str) else str(x).lower()


def rules_sql() -> str:
    limit = lambda text: None if text is None else float(text.strip("("))
    rows = [(n, limit(low), (low or "").startswith("("), limit(high), kind, needs) for n, low, high, kind, needs in settings.RULES]
    return "rules(name, low, open, high, kind, needs) as (values " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows) + ")"


SWITCHES = {"one_photon_registration.enabled": 2, "nonrigid_registration.enabled": 3, "roi_detection.enabled": 5}
#: Customers are recordings; the k-th setting by name gets a number from the customer's.
CHOSEN = f"""with {rules_sql()}, names as (select name, row_number() over (order by name) as k from (select distinct name from rules)),
chosen as (select c_custkey as key, name, (c_custkey * (k * 7 + 3) % 53 - 6) / 10.0::double as number from customer, names),
on_ as (select c_custkey as key, switch from customer, (values {", ".join(f"('{n}', {k})" for n, k in SWITCHES.items())}) as s(switch, k) where c_custkey % k = 0),
broken as (
  select c.key, c.name, r.kind, 'out of range' as problem, r.needs from chosen c join rules r on r.name = c.name where number < low or (open and number = low) or number > high
  union all select key, name, 'error', 'not even', 'one_photon_registration.enabled' from chosen
  where name in ('one_photon_registration.spatial_highpass_window', 'one_photon_registration.pre_smoothing_sigma') and number >= 0 and trunc(number) % 2 <> 0),
held as (select b.key, b.name, kind, problem from broken b left join on_ o on o.key = b.key and o.switch = b.needs where b.needs is null or o.key is not null),
told as (select *, max((kind = 'error')::int) over (partition by key, name) as wrong from held)"""


def chosen_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = sorted({r[0] for r in settings.RULES})
    key, k = F.col("c_custkey"), F.col("k")
    each = spark.createDataFrame([(n, i * 7 + 10, False) for i, n in enumerate(names)] + [(n, i, True) for n, i in SWITCHES.items()], "name string, k int, switch boolean")
    value = F.when(F.col("switch"), (key % k == 0).cast("string")).otherwise(((key * k % 53 - 6) / F.lit(10.0)).cast("string"))
    customers = read(spark, sf_dir, "customer").select("c_custkey")
    dealt = customers.repartition(customers.count() // 50_000 + 1, "c_custkey")  # a small file makes many rows
    return dealt.crossJoin(F.broadcast(each)).select(key.alias("key"), "name", value.alias("value"))  # a fixed table


@query(f"{CHOSEN} select key, name, kind, problem from told where kind = 'error' or wrong = 0")
def config_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settings.findings(chosen_settings(spark, sf_dir))


@query(f"""{CHOSEN}, kept as (select * from told where kind = 'error' or wrong = 0)
select c_custkey as key, count(*) filter (kind = 'error') as errors, count(*) filter (kind = 'warning') as warnings, count(*) filter (kind = 'error') = 0 as valid from customer left join kept on key = c_custkey group by c_custkey""")
def config_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settings.verdicts(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), settings.findings(chosen_settings(spark, sf_dir)))


@query("""with files as (select s_nationkey as recording, s_name as file, s_suppkey * 37 % 701 * (s_suppkey % 9 > 0)::int as pages, 8 + (s_suppkey % 7 = 0)::int as height, 8 as width, case s_suppkey % 5 when 0 then 'int16' when 1 then 'uint8' else 'uint16' end as kind from supplier),
full_ as (select * from files where pages > 0),
shapes as (select recording, height, width, sum(pages) as pages, count(*) as alike, min(file) as first from full_ group by all),
usual as (select *, row_number() over (partition by recording order by pages desc, first) as place from shapes),
kinds as (select recording, arg_min(kind, file) as kind, count(*) as whole_ from full_ group by recording),
others as (select f.recording, count(*) filter (f.kind <> k.kind) as other_kinds from full_ f join kinds k on k.recording = f.recording group by f.recording),
counts as (select recording, count(*) as files, count(*) filter (pages = 0) as empty_files from files group by recording),
found as (select n_nationkey as recording, (n_nationkey % 3 + 1) * (n_nationkey % 2 + 1) as cycle, coalesce(files, 0) as files, coalesce(empty_files, 0) as empty_files, coalesce(pages, 0)::bigint as pages, height, width, kind, coalesce(whole_, 0) - coalesce(alike, 0) as odd_files, coalesce(other_kinds, 0) as other_kinds
  from nation left join counts c on c.recording = n_nationkey left join usual u on u.recording = n_nationkey and place = 1 left join kinds k on k.recording = n_nationkey left join others o on o.recording = n_nationkey),
told as (select * exclude (cycle), pages // cycle as frames, pages % cycle as left_over, (files = 0)::int + empty_files as errors from found)
select * replace (coalesce(height, 0) as height, coalesce(width, 0) as width, coalesce(kind, '') as kind), (odd_files > 0)::int + (other_kinds > 0)::int + (left_over > 0)::int + (pages > 0 and frames < 200)::int + coalesce(kind not in ('uint16', 'int16', 'int32'), false)::int + coalesce(kind in ('uint16', 'int32'), false)::int as warnings, errors = 0 as valid from told""")
def acquisition_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    recordings = read(spark, sf_dir, "nation").select(key.alias("recording"), (key % 3 + 1).alias("planes"), (key % 2 + 1).alias("channels"))
    s = F.col("s_suppkey")
    kind = F.when(s % 5 == 0, "int16").when(s % 5 == 1, "uint8").otherwise("uint16")
    pages = s * 37 % 701 * (s % 9 > 0).cast("int")
    files = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("recording"), F.col("s_name").alias("file"), pages.alias("pages"), (8 + (s % 7 == 0).cast("int")).alias("height"), F.lit(8).alias("width"), kind.alias("kind"))
    return settings.readiness(recordings, files).na.fill({"height": 0, "width": 0, "kind": ""})
