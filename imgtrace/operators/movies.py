"""Movies: filters along frames, extremes, mosaics of planes and correction between channels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from imgtrace.functions import temporal
from imgtrace.operators.frames import lists

#: Widths from which a Gaussian along frames costs more than means of blocks.
GAUSSIAN_BELOW = 10


def _yx(width: int) -> tuple[Column, Column]:
    return F.floor(F.col("pixel") / width).cast("long"), (F.col("pixel") % width).cast("long")


def weighted_in_time(traces: DataFrame, region: str, frame: str, value: str, sigma: float, reach: int) -> DataFrame:
    """Adds `smooth`: Gaussian weights over `reach` frames each way, the trace mirrored at its ends (edge frames come twice).

    Frames must be 0, 1, 2, ... in each region. A window of the region's frames holds all that weigh on a frame, mirror
    images too, so nothing is sent but the trace itself.
    """
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weights /= weights.sum()
    whole = Window.partitionBy(region)
    held = traces.withColumns({"_near": F.collect_list(value).over(whole.orderBy(frame).rowsBetween(-reach, reach)), "_n": F.count("*").over(whole)})
    first = F.greatest(F.col(frame) - reach, F.lit(0))
    smooth = F.lit(0.0)
    for k, weight in zip(range(-reach, reach + 1), weights.tolist(), strict=True):
        at = F.pmod(F.col(frame) + k, 2 * F.col("_n"))
        place = F.when(at < F.col("_n"), at).otherwise(2 * F.col("_n") - 1 - at) - first
        smooth = smooth + weight * F.element_at("_near", (place + 1).cast("int"))
    return held.withColumn("smooth", smooth).drop("_near", "_n")


def high_pass(traces: DataFrame, region: str, frame: str, value: str, width: int) -> DataFrame:
    """Adds `passed`: the trace less its slow part, by a Gaussian of that width for widths below GAUSSIAN_BELOW, else by means of blocks."""
    if width < GAUSSIAN_BELOW:
        smooth = weighted_in_time(traces, region, frame, value, width, int(4 * width + 0.5))
        return smooth.withColumn("passed", F.col(value) - F.col("smooth")).drop("smooth")
    return temporal.block_high_pass(traces, region, frame, value, width)


def block_slopes(images: DataFrame, height: int, width: int, blocks: int) -> DataFrame:
    """Slope of the second image on the first, sum(fs) / sum(ff), in each of blocks by blocks parts (rows: pixel, first, second)."""
    y, x = _yx(width)
    placed = images.withColumns({"by": F.floor(y * blocks / height).cast("long"), "bx": F.floor(x * blocks / width).cast("long")})
    return placed.groupBy("by", "bx").agg((F.sum(F.col("first") * F.col("second")) / F.sum(F.col("first") * F.col("first"))).alias("slope"))


def bleedthrough_corrected(images: DataFrame, height: int, width: int, blocks: int) -> DataFrame:
    """The second image less its block's slope times the first, 0 at least."""
    y, x = _yx(width)
    placed = images.withColumns({"by": F.floor(y * blocks / height).cast("long"), "bx": F.floor(x * blocks / width).cast("long")})
    joined = placed.join(block_slopes(images, height, width, blocks), ["by", "bx"])
    return joined.select("pixel", F.greatest(F.lit(0.0), F.col("second") - F.col("slope") * F.col("first")).alias("value"))


def extreme_means(movie: DataFrame, scores: DataFrame, count: int) -> DataFrame:
    """For each component (rows: component, frame, score) the mean image of its `count` lowest and highest frames."""
    rank = lambda order: F.row_number().over(Window.partitionBy("component").orderBy(order, "frame"))
    ranked = scores.withColumns({"low": rank(F.asc("score")), "high": rank(F.desc("score"))})
    ends = F.array_compact(F.array(F.when(F.col("low") <= count, F.lit("low")), F.when(F.col("high") <= count, F.lit("high"))))
    chosen = ranked.select("component", "frame", F.explode(ends).alias("end"))
    return movie.join(chosen, "frame").groupBy("component", "end", "pixel").agg(F.avg("value").alias("value"))


def combined(planes: DataFrame, offsets: DataFrame, height: int, width: int, mosaic_height: int, mosaic_width: int) -> DataFrame:
    """frame and pixels of mosaics of all planes (plane, frame, pixels), 0 where no plane lies, cut to the frames that every plane has."""
    shortest = planes.groupBy("plane").agg(F.max("frame").alias("last")).agg(F.min("last")).scalar()
    placed = planes.join(F.broadcast(offsets), "plane").where(F.col("frame") <= shortest)
    parts = placed.groupBy("frame").agg(F.collect_list(F.struct("y", "x", F.col("pixels").cast("array<double>").alias("pixels"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                canvas = np.zeros((batch.num_rows, mosaic_height, mosaic_width))
                for out, own in zip(canvas, batch.column("parts").to_pylist(), strict=True):
                    for p in own:
                        out[p["y"] : p["y"] + height, p["x"] : p["x"] + width] = np.reshape(p["pixels"], (height, width))
                yield pa.RecordBatch.from_arrays([batch.column("frame"), lists(canvas)], ["frame", "pixels"])

    return parts.select(F.col("frame").cast("long").alias("frame"), "parts").mapInArrow(run, "frame long, pixels array<double>")
