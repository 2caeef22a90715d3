"""Window-like operators on traces: rows of a region, a frame number and a value.

All partition by region, so a trace is sorted once within its own partition; what is common to all regions of a frame is
aggregated first and joined, so no window ever holds a whole frame or the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def half_day(ts: Column, origin: str = "2024-01-01") -> Column:
    """Number of the half day since the origin; the same in every session time zone."""
    return (F.datediff(F.to_date(ts), F.lit(origin).cast("date")) * 2 + F.floor(F.hour(ts) / 12)).cast("long")


def numbered(rows: DataFrame, region: str, *order: str) -> DataFrame:
    """Adds `frame`, the place of a row in its region, from 0."""
    return rows.withColumn("frame", (F.row_number().over(Window.partitionBy(region).orderBy(*order)) - 1).cast("long"))


def binned(rows: DataFrame, region: str, frame: str, value: str) -> DataFrame:
    return rows.groupBy(region, frame).agg(F.avg(value).alias("f"))


def maximin_baseline(traces: DataFrame, region: str, frame: str, value: str, half: int) -> DataFrame:
    """Adds `baseline`: the running maximum of the running minimum of (smoothed) values over 2 * half + 1 frames; repeating the end values beyond the ends would not change it."""
    near = Window.partitionBy(region).orderBy(frame).rowsBetween(-half, half)
    low = traces.withColumn("low", F.min(value).over(near))
    return low.withColumn("baseline", F.max("low").over(near)).drop("low")


def neuropil_subtracted(traces: DataFrame, region: str, frame: str, value: str, coefficient: float) -> DataFrame:
    """Adds `corrected`: the value less a share of the mean of the frame's other regions (0 if there are none)."""
    whole = traces.groupBy(frame).agg(F.sum(value).alias("total"), F.count(value).alias("n"))
    others = F.when(F.col("n") > 1, (F.col("total") - F.col(value)) / (F.col("n") - 1)).otherwise(0.0)
    return traces.join(whole, frame).withColumn("corrected", F.col(value) - coefficient * others).drop("total", "n")


def constant_baseline(traces: DataFrame, value: str, smooth: str) -> DataFrame:
    """Adds `delta`: the value less the least smoothed value of all regions."""
    return traces.withColumn("delta", F.col(value) - traces.agg(F.min(smooth)).scalar())


def percentile_baseline(traces: DataFrame, region: str, value: str, share: float) -> DataFrame:
    """Adds `delta`: the value less its region's percentile, with linear interpolation."""
    base = traces.groupBy(region).agg(F.percentile(value, F.lit(share)).alias("base"))
    return traces.join(base, region).withColumn("delta", F.col(value) - F.col("base")).drop("base")


def full_bins(rows: DataFrame, region: str, frame: str, value: str, size: int) -> DataFrame:
    """Mean of each full bin of `size` frames; the remainder of a region is left out."""
    bins = rows.groupBy(region, F.floor(F.col(frame) / size).cast("long").alias("bin")).agg(F.avg(value).alias("f"), F.count("*").alias("n"))
    return bins.where(F.col("n") == size).drop("n")


def bins_without_bad(rows: DataFrame, frame: str, value: str, bad: Column, batch: int, size: int) -> DataFrame:
    """Per batch of frames: bad ones go if more than half are good, then means of full bins, or one mean if there are too few."""
    marked = rows.withColumns({"batch": F.floor(F.col(frame) / batch).cast("long"), "good": ~bad})
    shares = marked.groupBy("batch").agg(F.avg(F.col("good").cast("double")).alias("share"))
    kept = marked.join(shares, "batch").where(F.col("good") | (F.col("share") <= 0.5))
    counts = kept.groupBy("batch").agg(F.count("*").alias("n"))
    ranked = kept.withColumn("k", F.row_number().over(Window.partitionBy("batch").orderBy(frame)) - 1).join(counts, "batch")
    binned = ranked.withColumn("bin", F.when(F.col("n") > size, F.floor(F.col("k") / size)).otherwise(0).cast("long"))
    full = binned.where((F.col("n") <= size) | (F.col("k") < F.floor(F.col("n") / size) * size))
    return full.groupBy("batch", "bin").agg(F.avg(value).alias("f"))


def block_high_pass(rows: DataFrame, region: str, frame: str, value: str, size: int) -> DataFrame:
    """Adds `passed`: the value less the mean of its block of `size` frames; a remainder joins the last full block."""
    counts = rows.groupBy(region).agg(F.count("*").alias("n"))
    last = F.greatest(F.floor(F.col("n") / size) - 1, F.lit(0))
    blocks = rows.join(counts, region).withColumn("block", F.least(F.floor(F.col(frame) / size), last).cast("long"))
    means = blocks.groupBy(region, "block").agg(F.avg(value).alias("mean"))
    return blocks.join(means, [region, "block"]).withColumn("passed", F.col(value) - F.col("mean")).drop("n", "mean")


def threshold_energy(rows: DataFrame, region: str, value: str, above: float) -> DataFrame:
    return rows.groupBy(region).agg(F.sqrt(F.sum(F.when(F.col(value) > above, F.col(value) * F.col(value)).otherwise(0.0))).alias("energy"))


def read_window(traces: DataFrame, region: str, frame: str, regions: list[int], start: int, end: int, step: int) -> DataFrame:
    """Traces of some regions (at most 50, or it is an error), every step-th frame from `start` up to but without `end`."""
    if len(regions) > 50:
        raise ValueError(f"{len(regions)} regions at once, where 50 are the most")
    wanted = F.col(region).isin(regions) & (F.col(frame) >= start) & (F.col(frame) < end)
    return traces.where(wanted & ((F.col(frame) - start) % step == 0))


def correlation_with(traces: DataFrame, chosen: DataFrame, region: str, frame: str, value: str) -> DataFrame:
    """Pearson correlation of each region's trace with the mean trace of the chosen regions."""
    mean = traces.join(chosen, region, "left_semi").groupBy(frame).agg(F.avg(value).alias("mean"))
    return traces.join(mean, frame).groupBy(region).agg(F.corr(value, "mean").alias("correlation"), F.count("*").alias("n"))


def population_average(traces: DataFrame, frame: str, value: str, least: int) -> DataFrame:
    return traces.groupBy(frame).agg(F.avg(value).alias("average"), F.count("*").alias("n")).where(F.col("n") >= least)


def running_median(rows: DataFrame, plane: str, frame: str, value: str, half: int) -> Column:
    """Median of the 2 * half + 1 frames around each, with zeros beyond the ends."""
    near = F.collect_list(value).over(Window.partitionBy(plane).orderBy(frame).rowsBetween(-half, half))
    padded = F.concat(near, F.array_repeat(F.lit(0.0), 2 * half + 1 - F.size(near)))
    return F.element_at(F.array_sort(padded), half + 1)


def evenly_spaced(rows: DataFrame, frame: str, count: int) -> DataFrame:
    """Rows of `count` evenly spaced frames between the first and the last."""
    last = rows.agg(F.max(frame)).scalar()
    spark = rows.sparkSession
    wanted = spark.range(count).select(F.floor(F.col("id") * last / (count - 1)).cast("long").alias(frame)).distinct()
    return rows.join(wanted, frame, "left_semi")


def demultiplexed(pages: DataFrame, page: str, planes: int, channels: int) -> DataFrame:
    """Adds plane, channel and frame to interleaved pages; an incomplete last cycle is left out."""
    cycle = planes * channels
    whole = pages.agg(F.floor((F.max(page) + 1) / cycle)).scalar()
    placed = pages.withColumns(
        {
            "plane": F.floor((F.col(page) % cycle) / channels).cast("long"),
            "channel": (F.col(page) % channels).cast("long"),
            "frame": F.floor(F.col(page) / cycle).cast("long"),
        }
    )
    return placed.where(F.col("frame") < whole)
