"""Pixel sets of regions as rows of (region, pixel, weight): overlap, matching, extraction, templates.

Everything meets on the pixel by an equi-join (an inverted index), so the work follows the shared pixels, not all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of pairs on shared pixels that a task takes up.
PAIRS = 4_000_000


def normalized(masks: DataFrame, region: str, weight: str) -> DataFrame:
    total = masks.groupBy(region).agg(F.sum(weight).alias("total"))
    return masks.join(total, region).withColumn("share", F.col(weight) / F.col("total")).drop("total")


def overlap_count(masks: DataFrame, pixel: str) -> DataFrame:
    """How many regions hold each pixel."""
    return masks.groupBy(pixel).agg(F.count("*").alias("regions"))


def overlap_flags(masks: DataFrame, pixel: str) -> DataFrame:
    """Adds `overlaps`: whether another region holds the pixel too."""
    return masks.join(overlap_count(masks, pixel), pixel).withColumn("overlaps", F.col("regions") > 1).drop("regions")


def extract_trace(masks: DataFrame, movie: DataFrame, region: str, pixel: str, frame: str, weight: str, value: str) -> DataFrame:
    """Weighted sum of the movie's pixels under each mask, by frame."""
    return masks.join(movie, pixel).groupBy(region, frame).agg(F.sum(F.col(weight) * F.col(value)).alias("f"))


def background_mean(masks: DataFrame, movie: DataFrame, pixel: str, frame: str, value: str) -> DataFrame:
    """Mean of the pixels outside all masks, by frame."""
    return movie.join(masks.select(pixel).distinct(), pixel, "left_anti").groupBy(frame).agg(F.avg(value).alias("background"), F.count("*").alias("pixels"))


def shared_pixels(left: DataFrame, right: DataFrame, region: str, pixel: str) -> DataFrame:
    """a, b, shared, n_a and n_b of all pairs of regions that share a pixel."""
    tasks = _tasks(_held(left, region, pixel, "x").join(_held(right, region, pixel, "y"), pixel, "full"), F.coalesce(F.col("x") * F.col("y"), F.lit(0)), F.coalesce("x", "y"))
    others = _sized(_rows(right, region, pixel)).repartition(tasks, "pixel")
    lists = others.groupBy("pixel").agg(F.collect_list("region").alias("ys"), F.collect_list("n").alias("n_ys"))
    return _counted(_blocks(left, region, pixel, tasks).join(lists, "pixel"), tasks)


def _own_pairs(masks: DataFrame, region: str, pixel: str) -> DataFrame:
    """shared_pixels of a table with itself, each pair once, the lower region first: a block's regions meet those of its own and of higher blocks."""
    tasks = _tasks(_held(masks, region, pixel, "x"), F.col("x") * (F.col("x") - 1) / 2, F.col("x"))
    higher = Window.partitionBy("pixel").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lists = {"ys": F.flatten(F.collect_list("xs").over(higher)), "n_ys": F.flatten(F.collect_list("n_xs").over(higher))}
    return _counted(_blocks(masks, region, pixel, tasks).withColumns(lists), tasks, own=True)


def _held(masks: DataFrame, region: str, pixel: str, n: str) -> DataFrame:
    return masks.where(F.col(region).isNotNull() & F.col(pixel).isNotNull()).groupBy(pixel).agg(F.count("*").alias(n))


def _tasks(held: DataFrame, pairs: Column, rows: Column) -> int:
    return int(max(n or 0 for n in held.select(F.sum(pairs), F.sum(rows)).first()) // PAIRS) + 1


def _rows(masks: DataFrame, region: str, pixel: str) -> DataFrame:
    return masks.select(F.col(region).alias("region"), F.col(pixel).alias("pixel")).where("region is not null")


def _sized(rows: DataFrame, *more: Column) -> DataFrame:
    """The region's size beside each pixel, so that pairs need no second look at the masks; a pixel without a number counts for it but meets none."""
    return rows.select("region", "pixel", F.count("*").over(Window.partitionBy("region")).cast("int").alias("n"), *more).where("pixel is not null")


def _blocks(masks: DataFrame, region: str, pixel: str, tasks: int) -> DataFrame:
    """pixel, block, xs and n_xs: a pixel's regions of each block, and their sizes. Blocks are ranges of regions, as neighbours in number often share pixels."""
    ranges = _rows(masks, region, pixel).repartitionByRange(tasks, "region")
    sized = _sized(ranges, F.spark_partition_id().alias("block")).repartition(tasks, "pixel")
    return sized.groupBy("pixel", "block").agg(F.collect_list("region").alias("xs"), F.collect_list("n").alias("n_xs"))


def _one_a_task(spark: SparkSession, tasks: int) -> list[int]:
    """Numbers that Spark's hash deals into tasks 0, 1, 2, ..., one each, where any numbers in a row would leave some empty and fill others twice or more."""
    task = F.pmod(F.hash("id"), F.lit(tasks)).alias("task")
    return [r.id for r in spark.range(32 * tasks).groupBy(task).agg(F.min("id").alias("id")).orderBy("task").collect()]


def _counted(met: DataFrame, tasks: int, own: bool = False) -> DataFrame:
    """Pairs of xs and ys by their number of pixels, in tasks of about PAIRS such rows; `own` pairs are those of ys, that end with xs.

    Lists travel to the task of their block, and become pairs only there, where all rows of a pair are: no pair passes a
    shuffle, and a task's memory stays as the input grows.
    """
    number = F.array(*(F.lit(n) for n in _one_a_task(met.sparkSession, tasks))).cast("array<long>")[F.col("block") % tasks]  # blocks that share a number share no pair
    travel = met.select(number.alias("a"), "ys", "n_ys", *([F.size("xs").alias("last")] if own else ["xs", "n_xs"]))
    dealt = travel.repartition(tasks, "a").withColumnRenamed("a", "block")
    if own:
        dealt = dealt.withColumns({x: F.slice(y, F.size(y) - F.col("last") + 1, F.col("last")) for x, y in (("xs", "ys"), ("n_xs", "n_ys"))})
    first = dealt.select("block", F.posexplode("xs").alias("i", "a"), "n_xs", "ys", "n_ys").select("block", "a", F.col("n_xs")[F.col("i")].cast("long").alias("n_a"), "ys", "n_ys")
    pairs = first.select("block", "a", "n_a", F.posexplode("ys").alias("j", "b"), "n_ys").select("block", "a", "b", "n_a", F.col("n_ys")[F.col("j")].cast("long").alias("n_b"))
    pairs = pairs.where("a < b") if own else pairs
    return pairs.groupBy("block", "a", "b", "n_a", "n_b").agg(F.count("*").alias("shared")).select("a", "b", "shared", "n_a", "n_b")


def jaccard(masks: DataFrame, region: str, pixel: str) -> DataFrame:
    pairs = _own_pairs(masks, region, pixel)
    return pairs.withColumn("jaccard", F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared")))


def least_overlap(masks: DataFrame, region: str, pixel: str) -> DataFrame:
    pairs = _own_pairs(masks, region, pixel)
    return pairs.withColumn("overlap", F.col("shared") / F.least("n_a", "n_b"))


def mutual_matches(first: DataFrame, second: DataFrame, region: str, pixel: str, least: float) -> DataFrame:
    """For each region of `first`, the region of `second` that it matches best and that matches it best; -1 and 0 without one.

    Ties go to the lower region; matches below `least` of the smaller mask count as none.
    """
    scored = shared_pixels(first, second, region, pixel).withColumn("score", F.col("shared") / F.least("n_a", "n_b"))
    best = lambda by, other: F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), other))
    ranked = scored.withColumns({"rank_a": best("a", "b"), "rank_b": best("b", "a")})
    matched = ranked.where((F.col("rank_a") == 1) & (F.col("rank_b") == 1) & (F.col("score") >= least)).select("a", "b", "score")
    every = first.select(F.col(region).alias("a")).distinct()
    return every.join(matched, "a", "left").select("a", F.coalesce("b", F.lit(-1)).alias("matched"), F.coalesce("score", F.lit(0.0)).alias("score"))


def intensity_colocalization(masks: DataFrame, image: DataFrame, region: str, pixel: str, weight: str, value: str) -> DataFrame:
    """inside / (inside + outside): the weighted mean under the mask against the mean of the pixels that no mask of this region holds."""
    total, n = image.agg(F.sum(value)).scalar(), image.agg(F.count("*")).scalar()
    inside = masks.join(image, pixel).groupBy(region).agg(
        F.greatest(F.lit(1e-3), F.sum(F.col(weight) * F.col(value)) / F.sum(weight)).alias("inside"), F.sum(value).alias("own"), F.count("*").alias("own_n")
    )
    left = n - F.col("own_n")
    outside = F.when(left > 0, (total - F.col("own")) / left).otherwise(0.0)
    return inside.withColumn("probability", F.col("inside") / (F.col("inside") + outside)).select(region, "inside", "probability")


def without(masks: DataFrame, others: DataFrame, pixel: str) -> DataFrame:
    """Pixels that none of the other masks hold."""
    return masks.join(others.select(pixel).distinct(), pixel, "left_anti")


def dilated(masks: DataFrame, region: str, pixel: str, width: int, height: int) -> DataFrame:
    """Each mask with its pixels' four neighbours inside the image."""
    y, x = F.floor(F.col(pixel) / width), F.col(pixel) % width
    steps = F.array(*(F.struct((y + dy).cast("long").alias("y"), (x + dx).cast("long").alias("x")) for dy, dx in ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))))
    moved = masks.select(region, F.explode(steps).alias("p")).select(region, "p.*")
    return moved.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1)).select(region, (F.col("y") * width + F.col("x")).alias(pixel)).distinct()


def free_lines(lines: DataFrame, taken: list[tuple[DataFrame, list[str]]], pixel: str, width: int) -> DataFrame:
    """Lines (y, x0 and x1, both inside the image and inclusive) with xs, the places in them that the taken tables (keys and pixel) don't hold.

    Taken pixels meet the lines as one list of at most `width` places a row of the image, so pixels go through no shuffle.
    """
    places = F.array().cast("array<long>")
    for k, (table, keys) in enumerate(taken):
        y, x = F.floor(F.col(pixel) / width).cast("long"), (F.col(pixel) % width).cast("long")
        rows = table.groupBy(*keys, y.alias("y")).agg(F.collect_set(x).alias(f"taken_{k}"))
        lines = lines.join(rows, [*keys, "y"], "left")
        places = F.concat(places, F.coalesce(f"taken_{k}", F.array().cast("array<long>")))
    free = F.array_except(F.sequence(F.col("x0").cast("long"), F.col("x1").cast("long")), places)
    return lines.select(*(c for c in lines.columns if c not in ("x0", "x1") and not c.startswith("taken_")), free.alias("xs"))


def line_pixels(lines: DataFrame, pixel: str, width: int) -> DataFrame:
    """A row for each place of lines with y and xs, by its pixel.

    Explodes a copy of xs: of a plain column Spark would first ask for its size, and so make every list again.
    """
    rest = [c for c in lines.columns if c not in ("y", "xs")]
    every = F.concat("xs", F.array().cast("array<long>"))
    return lines.select(*rest, "y", F.explode(every).alias("x")).select(*rest, (F.col("y") * width + F.col("x")).alias(pixel))


def consensus(members: DataFrame, cluster: str, member: str, pixel: str, weight: str, percent: int) -> DataFrame:
    """Pixels that enough members of a cluster hold, with their mean weight."""
    sizes = members.groupBy(cluster).agg(F.countDistinct(member).alias("members"))
    held = members.groupBy(cluster, pixel).agg(F.count("*").alias("holders"), F.avg(weight).alias("weight"))
    return held.join(sizes, cluster).where(F.col("holders") * 100 >= percent * F.col("members")).select(cluster, pixel, "holders", "weight")


def large_enough(masks: DataFrame, region: str, pixel: str, least: int) -> DataFrame:
    """Regions with at least so many pixels that no other region holds."""
    flagged = overlap_flags(masks, pixel)
    return flagged.groupBy(region).agg(F.count("*").alias("pixels"), F.sum(F.when(F.col("overlaps"), 0).otherwise(1)).alias("own")).where(F.col("own") >= least)


def near_pairs(rois: DataFrame, roi: str, recording: str, y: str, x: str, distance: float) -> DataFrame:
    """Pairs of regions of different recordings whose centres lie closer than `distance`: an equi-join on grid cells, then the exact test."""
    cell = lambda c: F.floor(F.col(c) / distance).cast("long")
    own = rois.select(F.col(roi).alias("a"), F.col(recording).alias("rec_a"), F.col(y).alias("y_a"), F.col(x).alias("x_a"), cell(y).alias("cy"), cell(x).alias("cx"))
    shifts = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)))
    other = rois.select(F.col(roi).alias("b"), F.col(recording).alias("rec_b"), F.col(y).alias("y_b"), F.col(x).alias("x_b"), cell(y).alias("cy0"), cell(x).alias("cx0"), F.explode(shifts).alias("s"))
    other = other.select("b", "rec_b", "y_b", "x_b", (F.col("cy0") + F.col("s.dy")).alias("cy"), (F.col("cx0") + F.col("s.dx")).alias("cx"))
    squared = F.pow(F.col("y_a") - F.col("y_b"), 2) + F.pow(F.col("x_a") - F.col("x_b"), 2)
    tasks = rois.count() // 100_000 + 1  # so that a task's memory stays as the input grows
    met = own.repartition(tasks, "cy", "cx").hint("merge").join(other.repartition(tasks, "cy", "cx"), ["cy", "cx"])
    pairs = met.where((F.col("a") < F.col("b")) & (F.col("rec_a") != F.col("rec_b")) & (squared < distance * distance))
    return pairs.select("a", "b", F.sqrt(squared).alias("distance"))


def moved_by_field(regions: DataFrame, field: DataFrame, recording: str, height: int, width: int) -> DataFrame:
    """recording, roi, pixel and weight of regions (recording, roi, pixel, weight) seen along a field (recording, pixel, dy, dx).

    Each pixel takes the weight of the nearest pixel to where its offsets point; nothing comes from beyond the image,
    and weights of 0 and pixels that none points to go. One join on the pixel pointed to.
    """
    nearest = lambda at, offset: F.floor(at + F.col(offset) + 0.5)
    y, x = nearest(F.floor(F.col("pixel") / width), "dy"), nearest(F.col("pixel") % width, "dx")
    inside = field.where((y >= 0) & (y < height) & (x >= 0) & (x < width))
    aimed = inside.select(recording, F.col("pixel").alias("target"), (y * width + x).cast("long").alias("pixel"))
    held = regions.where("weight <> 0").join(aimed, [recording, "pixel"])
    return held.select(recording, "roi", F.col("target").alias("pixel"), "weight")
