"""Principal components over a plane's frames, and how far frames at their two ends lie apart: a measure of motion left.

Frames have far more pixels than a plane has sampled frames, so components come from the frames' products with each other.
Frames are cut into blocks of pixels; a task holds one block of all sampled frames of a plane, takes each pixel's mean off,
and gives its share of all products, which add up in a tree. Only that square of sampled frames meets in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from imgtrace.operators.alignment import picked
from imgtrace.operators.frames import lists, mean_images, stacked, summed_images, translated
from imgtrace.operators.graphs import checkpointed
from imgtrace.operators.registration import Steps, Template, peaks

#: Pixels of a block, and sampled frames of a plane at most (a documented sample, evenly spaced, which bounds the square).
BLOCK, MOST = 4096, 2000


def products(frames: DataFrame, plane: str, frame: str, values: str, block: int = BLOCK) -> DataFrame:
    """plane, frame, products (with each of the plane's frames in order, each pixel's and then each frame's mean taken off)."""
    size = F.size(values)
    cut = frames.select(F.col(plane).cast("long").alias("plane"), F.col(frame).cast("long").alias("frame"), F.col(values).cast("array<double>").alias("v"), F.explode(F.sequence(F.lit(0), F.floor((size - 1) / block).cast("int"))).alias("block"))
    parts = cut.select("plane", "frame", "block", F.slice("v", F.col("block") * block + 1, block).alias("v"), F.size("v").alias("size"))

    def multiply(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("frame").combine_chunks()
        x = rows["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
        x = x - x.mean(0)
        share = np.concatenate([x @ x.T, x.sum(1, keepdims=True), rows["size"].to_numpy()[:, None] * (rows["block"].to_numpy()[:, None] == 0)], axis=1)
        return pa.table([rows["plane"], rows["frame"], lists(share)], names=["plane", "frame", "share"])

    shares = parts.groupBy("plane", "block").applyInArrow(multiply, "plane long, frame long, share array<double>")
    sums = summed_images(shares, ["plane", "frame"], "share")
    n = F.size("pixels")
    return sums.select("plane", "frame", F.slice("pixels", F.lit(1), n - 2).alias("products"), F.element_at("pixels", -2).alias("total"), F.element_at("pixels", -1).alias("size"))


def scores(frames: DataFrame, plane: str, frame: str, values: str, components: int, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """plane, frame, component (from 0, the strongest first), score and share (of the variance) of at most `most` frames a plane.

    A component's scores are a vector of length 1 over the frames; the largest is positive. Frames must be 0, 1, 2, ... in a
    plane. Planes with fewer frames than components give as many components as frames.
    """

    def solve(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("frame").combine_chunks()
        n = rows.num_rows
        total, size = rows["total"].to_numpy(), rows["size"].to_numpy()
        gram = rows["products"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, n) - np.outer(total, total) / size
        values, vectors = np.linalg.eigh((gram + gram.T) / 2)
        k = min(components, n)
        values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
        vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(k)] < 0, -1.0, 1.0)
        share = np.maximum(values, 0) / max(np.trace(gram), 1e-300)
        return pa.table([np.repeat(rows["plane"].to_numpy(), k), np.repeat(rows["frame"].to_numpy(), k), np.tile(np.arange(k), n), vectors.ravel(), np.tile(share, n)], names=["plane", "frame", "component", "score", "share"])

    sample = picked(frames.select(plane, frame, values), plane, frame, most)
    return products(sample, plane, frame, values, block).groupBy("plane").applyInArrow(solve, "plane long, frame long, component long, score double, share double")


def extremes(frames: DataFrame, found: DataFrame, plane: str, frame: str, values: str, count: int) -> DataFrame:
    """plane, component, low and high: mean images of the `count` frames with the lowest and the highest scores."""
    at = lambda *order: F.row_number().over(Window.partitionBy("plane", "component").orderBy(*order)) <= count
    ends = found.select("plane", "frame", "component", F.array_compact(F.array(F.when(at("score", "frame"), 0), F.when(at(F.desc("score"), F.desc("frame")), 1))).alias("ends"))
    chosen = ends.select("plane", "frame", "component", F.explode("ends").alias("end"))
    numbered = frames.select(F.col(plane).cast("long").alias("plane"), F.col(frame).cast("long").alias("frame"), F.col(values).alias("v"))
    means = mean_images(numbered.join(chosen, ["plane", "frame"]), ["plane", "component", "end"], "v")
    end = lambda k: F.max(F.when(F.col("end") == k, F.col("pixels")))
    return means.groupBy("plane", "component").agg(end(0).alias("low"), end(1).alias("high"))


def metrics(frames: DataFrame, plane: str, frame: str, values: str, steps: Steps, components: int, count: int, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """plane, component, share, rigid, blocks_mean and blocks_most: how far the high end's image lies from the low end's.

    rigid is the length of the whole-frame offset in pixels, the others are over what is then left between blocks (0
    without a grid). Small values say that registration left little motion along a component.
    """
    found = checkpointed(scores(frames, plane, frame, values, components, most, block))
    images = extremes(frames, found, plane, frame, values, count)

    def measure(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            low, high = (stacked(batch.column(c), steps.height, steps.width) for c in ("low", "high"))
            if steps.prepare:
                low, high = steps.prepare(low), steps.prepare(high)
            out = np.zeros((len(low), 3))
            for k in range(len(low)):
                template = Template(low[k], steps)
                seen = np.clip(high[k : k + 1], template.low, template.high)
                dy, dx, _ = peaks(template.surfaces(seen))
                dy, dx = dy - steps.reach, dx - steps.reach
                out[k, 0] = np.hypot(dy[0], dx[0])
                if steps.grid:
                    by, bx, _ = template.block_offsets(translated(seen, dy, dx))
                    out[k, 1:] = np.hypot(by, bx).mean(), np.hypot(by, bx).max()
            keep = [batch.column(c) for c in ("plane", "component")]
            yield pa.RecordBatch.from_arrays([*keep, *(pa.array(c) for c in out.T)], ["plane", "component", "rigid", "blocks_mean", "blocks_most"])

    measured = images.mapInArrow(measure, "plane long, component long, rigid double, blocks_mean double, blocks_most double")
    shares = found.groupBy("plane", "component").agg(F.first("share").alias("share"))
    return shares.join(measured, ["plane", "component"])
