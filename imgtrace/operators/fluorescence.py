"""Traces of a plane's regions from frames as arrays, for one channel or two.

A plane's masks and surrounds are packed into arrays, which travel with the first frame of each range of frames; a range is
one product of frames and masks. Only what is asked for becomes rows: a value for each region and frame.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from imgtrace.operators.frames import lists, stacked
from imgtrace.operators.registration import mirrored


def packed(masks: DataFrame, weight: str | None, name: str) -> DataFrame:
    """plane and a struct of arrays, sorted by region: rois, pixels and shares (equal ones without a weight) of rows (plane, roi, pixel, weight)."""
    rows = masks.select("plane", F.struct(F.col("roi").cast("long").alias("roi"), F.col("pixel").cast("long").alias("pixel"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("share")).alias("row"))
    every = rows.groupBy(F.col("plane").cast("long").alias("plane")).agg(F.sort_array(F.collect_list("row")).alias("rows"))
    return every.select("plane", F.struct(F.col("rows.roi").alias("rois"), F.col("rows.pixel").alias("pixels"), F.col("rows.share").alias("shares")).alias(name))


def _sums(frames: np.ndarray, mask: dict, mean: bool) -> tuple[np.ndarray, np.ndarray]:
    """rois and, for each frame, the sum (or the mean) of share times value over each region."""
    rois = np.array(mask["rois"], np.int64) if mask else np.zeros(0, np.int64)
    if not len(rois):
        return rois, np.zeros((len(frames), 0))
    starts = np.flatnonzero(np.diff(rois, prepend=rois[0] - 1))
    pixels, shares = np.array(mask["pixels"]), np.array(mask["shares"])
    out = np.stack([np.add.reduceat(f[pixels] * shares, starts) for f in frames])
    return rois[starts], out / np.add.reduceat(shares, starts) if mean else out


def traces(frames: DataFrame, built: DataFrame, around: DataFrame, plane: str, frame: str, values: str, height: int, width: int, coefficient: float, span: int = 64) -> DataFrame:
    """plane, roi, frame, fluorescence, neuropil (0 without a surround) and corrected (less a share of the neuropil).

    built has plane, roi, pixel and share (a region's sum is 1), around plane, roi and pixel. Frames must be 0, 1, 2, ... in
    a plane; planes without regions give no rows.
    """
    at = F.col(frame).cast("long")
    known = packed(built, "share", "mask").join(packed(around, None, "near"), "plane", "left")
    lead = lambda c: F.when(F.col("frame") % span == 0, F.col(c)).alias(c)
    sent = frames.select(F.col(plane).cast("long").alias("plane"), at.alias("frame"), F.floor(at / span).alias("range"), F.col(values).cast("array<double>").alias("pixels")).join(known, "plane")
    sent = sent.select("plane", "range", "frame", "pixels", lead("mask"), lead("near"))

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("frame").combine_chunks()
        numbers = rows["frame"].to_numpy()
        if numbers[0] % span:
            raise ValueError("frames of a plane must be numbered 0, 1, 2, ...")
        stack = stacked(rows["pixels"].combine_chunks(), height, width).reshape(len(numbers), -1)
        rois, own = _sums(stack, rows["mask"][0].as_py(), False)
        others, near = _sums(stack, rows["near"][0].as_py(), True)
        neuropil = np.zeros_like(own)
        has = np.isin(rois, others)
        neuropil[:, has] = near[:, np.searchsorted(others, rois[has])]
        columns = [np.full(own.size, rows["plane"][0].as_py()), np.tile(rois, len(numbers)), np.repeat(numbers, len(rois)), own.ravel(), neuropil.ravel(), (own - coefficient * neuropil).ravel()]
        return pa.table(columns, names=["plane", "roi", "frame", "fluorescence", "neuropil", "corrected"])

    return sent.groupBy("plane", "range").applyInArrow(run, "plane long, roi long, frame long, fluorescence double, neuropil double, corrected double")


def activity(found: DataFrame) -> DataFrame:
    """plane, roi, frames, mean, deviation and skewness (0 if constant) of the corrected traces."""
    value = F.col("corrected")
    return found.groupBy("plane", "roi").agg(
        F.count("*").alias("frames"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"), F.coalesce(F.nanvl(F.skewness(value), F.lit(0.0)), F.lit(0.0)).alias("skewness")
    )


def with_baseline(found: DataFrame, share: float) -> DataFrame:
    """Adds delta: the corrected trace less its own percentile."""
    base = F.percentile("corrected", F.lit(share)).over(Window.partitionBy("plane", "roi"))
    return found.withColumn("delta", F.col("corrected") - base)


# ---- second channel


def block_bounds(length: int, blocks: int) -> np.ndarray:
    return np.linspace(0, length, blocks + 1).astype(int)


def blends(length: int, blocks: int, sigma: int) -> np.ndarray:
    """Weights (blocks, length) of blocks along an axis: their extents smoothed by a Gaussian, mirrored at the ends; a pixel's sum is 1."""
    bounds = block_bounds(length, blocks)
    inside = np.array([(np.arange(length) >= a) & (np.arange(length) < b) for a, b in zip(bounds, bounds[1:], strict=False)], float)
    if sigma:
        reach = np.arange(-4 * sigma, 4 * sigma + 1)
        bell = np.exp(-0.5 * (reach / sigma) ** 2)
        inside = sum(w * inside[:, mirrored(np.arange(length) + k, length)] for k, w in zip(reach, bell / bell.sum(), strict=True))
    total = inside.sum(0)
    return inside / np.where(total == 0, 1, total)


def without_bleedthrough(functional: np.ndarray, structural: np.ndarray, blocks: int = 3, fraction: float = 0.25) -> np.ndarray:
    """Structural images (n, h, w) less what functional ones explain: a slope for each block, blended between blocks, never below 0."""
    _, h, w = functional.shape
    sigma = round((h + w) / (2 * blocks) * fraction)
    rows, columns = blends(h, blocks, sigma), blends(w, blocks, sigma)
    sums = lambda x: np.add.reduceat(np.add.reduceat(x, block_bounds(h, blocks)[:-1], axis=1), block_bounds(w, blocks)[:-1], axis=2)
    over, under = sums(functional * structural), sums(functional * functional)
    slopes = np.where(under > 0, over / np.where(under > 0, under, 1), 0)
    return np.maximum(0, structural - functional * (rows.T @ slopes @ columns))


def corrected_images(images: DataFrame, height: int, width: int) -> DataFrame:
    """plane and pixels: mean images (plane, functional, structural) of the second channel without bleedthrough."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                out = without_bleedthrough(*(stacked(batch.column(c), height, width) for c in ("functional", "structural")))
                yield pa.RecordBatch.from_arrays([batch.column("plane"), lists(out)], ["plane", "pixels"])

    return images.select(F.col("plane").cast("long").alias("plane"), "functional", "structural").mapInArrow(run, "plane long, pixels array<double>")


def colocalized(built: DataFrame, around: DataFrame, images: DataFrame, threshold: float) -> DataFrame:
    """plane, roi, inside, outside, probability (inside over both) and colocalized: the image under a mask against its surround (0 without one)."""
    pixels = images.select("plane", F.posexplode("pixels").alias("pixel", "value"))
    inside = built.join(pixels, ["plane", "pixel"]).groupBy("plane", "roi").agg(F.greatest(F.lit(1e-3), F.sum(F.col("share") * F.col("value"))).alias("inside"))
    outside = around.join(pixels, ["plane", "pixel"]).groupBy("plane", "roi").agg(F.avg("value").alias("outside"))
    both = inside.join(outside, ["plane", "roi"], "left").withColumn("outside", F.coalesce("outside", F.lit(0.0)))
    probability = F.col("inside") / (F.col("inside") + F.col("outside"))
    return both.select("plane", "roi", "inside", "outside", probability.alias("probability"), (probability > threshold).alias("colocalized"))
