"""Images over many frames: projections, steps, similarity and mosaics. Kernels of single frames are in `frames`."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pixels(frames: DataFrame, frame: str, values: str, *keep: str) -> DataFrame:
    return frames.select(F.col(frame).alias("frame"), *keep, F.posexplode(values).alias("pixel", "value")).withColumn("value", F.col("value").cast("double"))


def projection(movie: DataFrame) -> DataFrame:
    """Mean, maximum and population standard deviation of each pixel over the frames."""
    return movie.groupBy("pixel").agg(F.avg("value").alias("mean"), F.max("value").alias("maximum"), F.stddev_pop("value").alias("deviation"))


def mosaic_offsets(planes: DataFrame, plane: str, height: int, width: int) -> DataFrame:
    """Where each plane goes in a near-square mosaic, by the order of the planes."""
    count = planes.select(plane).distinct().agg(F.count("*")).scalar()
    columns = F.ceil(F.sqrt(F.lit(height * width) * count) / width)
    order = F.row_number().over(Window.orderBy(plane)) - 1
    ranked = planes.select(plane).distinct().withColumn("k", order)
    return ranked.select(plane, (F.floor(F.col("k") / columns) * height).cast("long").alias("y"), ((F.col("k") % columns) * width).cast("long").alias("x"))


def frame_steps(frames: DataFrame, frame: str, values: str) -> DataFrame:
    """Temporal deviation of each pixel: the root of the summed squared steps between neighbouring frames over the frame count.

    Frames meet the one after them as arrays; tasks add up their frames' squares before anything is dealt by pixel.
    """
    own = frames.select(F.col(frame).alias("frame"), F.col(values).cast("array<double>").alias("v"))
    steps = own.join(own.select((F.col("frame") - 1).alias("frame"), F.col("v").alias("after")), "frame", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(0), 0
        for batch in batches:
            for v, after in zip(batch.column("v").to_pylist(), batch.column("after").to_pylist(), strict=True):
                square = np.square(np.subtract(after, v)) if after is not None else np.zeros(len(v))
                total, n = total + square if n else square, n + 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total), pa.array(np.full(len(total), n))], ["pixel", "total", "n"])

    sums = steps.select("v", "after").mapInArrow(run, "pixel long, total double, n long")
    return sums.groupBy("pixel").agg(F.greatest(F.lit(1e-10), F.sqrt(F.sum("total") / F.sum("n"))).alias("deviation"))


def summary(rows: DataFrame, by: list[str], value: Column, digits: int = 4) -> DataFrame:
    """Least, greatest, mean and population deviation without NaN, rounded."""
    clean = F.when(~F.isnan(value), value)
    stats = {"least": F.min(clean), "greatest": F.max(clean), "mean": F.avg(clean), "deviation": F.stddev_pop(clean)}
    return rows.groupBy(*by).agg(*(F.round(c, digits).alias(n) for n, c in stats.items()))


#: Bytes of a block of frames (as doubles), its frames at most, and pairs of frames whose correlations a task holds at once.
BLOCK_BYTES, BLOCK_FRAMES, AT_ONCE = 8 << 20, 8192, 1 << 21


def dealt_pairs(frames: DataFrame, frame: str, plane: str, values: str, block: int) -> tuple[DataFrame, DataFrame]:
    """plane, frame, v and a pair of blocks a <= b, for each pair of a frame's block: as frames of a, and of another b."""
    numbers = frames.select(F.col(plane).cast("long").alias("plane"), F.col(frame).cast("long").alias("frame"), F.col(values).alias("v"))
    needed = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum(F.size("v") * F.lit(8.0)) / BLOCK_BYTES))
    blocks = numbers.groupBy("plane").agg(needed.cast("int").alias("blocks"))
    dealt = numbers.join(blocks, "plane").withColumn("block", F.pmod(F.xxhash64("frame"), F.col("blocks")).cast("int"))
    left = dealt.select("plane", "frame", "v", F.col("block").alias("a"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("b"))
    own = (F.col(c).alias(c) for c in ("plane", "frame", "v"))
    return left, dealt.where("block > 0").select(*own, F.explode(F.sequence(F.lit(0), F.col("block") - 1)).alias("a"), F.col("block").alias("b"))


def similar_frames(frames: DataFrame, frame: str, plane: str, values: str, most: int, block: int = BLOCK_FRAMES) -> DataFrame:
    """For each frame the `most` frames of its plane that correlate best with it, ties to the lower one.

    A plane's frames are dealt into blocks by a hash, of BLOCK_BYTES and `block` frames at most, and each task compares two
    blocks, both ways, so it holds two blocks and AT_ONCE correlations however long the plane; the best of each block meet
    in a window. Pairs are quadratic in a plane's frames; what is sent grows with the frames times the number of blocks.
    """
    left, right = dealt_pairs(frames, frame, plane, values, block)

    def unit(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        table = table.sort_by("frame").combine_chunks()
        x = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(table.num_rows, -1)
        x = x - x.mean(1, keepdims=True)
        return table["frame"].to_numpy(), x / np.maximum(1e-300, np.sqrt((x * x).sum(1, keepdims=True)))

    def best(names: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray, same: bool) -> list[tuple]:
        """Names, others and correlations of the best of each of some frames, a strip of frames at a time."""
        found, n, rows = [], min(most, len(others)), max(1, AT_ONCE // len(others))
        for start in range(0, len(names), rows):
            own = names[start : start + rows]
            close = x[start : start + rows] @ y.T
            if same:
                close[own[:, None] == others] = -np.inf
            # Rounding keeps the order, so all that round to the last one's value or more lie above this.
            limit = np.partition(close, len(others) - n, axis=1)[:, len(others) - n] - 2e-6
            row, column = np.nonzero((close >= limit[:, None]) & (close > -np.inf))
            value = np.round(close[row, column], 6)
            order = np.lexsort((-value, row))  # stable, so ties stay in the others' order
            place = np.arange(len(row)) - np.searchsorted(row, row[order])
            kept = order[place < most]
            found.append((own[row[kept]], others[column[kept]], value[kept]))
        return found

    def compare(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        of, found = key[0].as_py(), []
        names, x = unit(left) if left.num_rows else (np.zeros(0, np.int64), None)
        if x is not None and key[1] == key[2]:
            found = best(names, x, names, x, True)
        elif x is not None and right.num_rows:
            others, y = unit(right)
            found = best(names, x, others, y, False) + best(others, y, names, x, False)
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0)] * 3
        types = (pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(np.full(len(columns[0]), of), pa.int64()), *(pa.array(c.astype(t.to_pandas_dtype()), t) for c, t in zip(columns, types, strict=True))], names=["plane", "frame", "other", "correlation"])

    pairs = left.groupBy("plane", "a", "b").cogroup(right.groupBy("plane", "a", "b")).applyInArrow(compare, "plane long, frame long, other long, correlation double")
    place = F.row_number().over(Window.partitionBy("plane", "frame").orderBy(F.desc("correlation"), "other"))
    return pairs.withColumn("place", place.cast("long")).where(F.col("place") <= most)
