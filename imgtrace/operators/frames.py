"""Frames as arrays, a row each: kernels that take a batch of frames of h by w pixels at a time.

Frames do not depend on each other, so nothing is shuffled: a kernel is one pass over Arrow batches, and what it needs
besides the frames (offsets, fields) comes as columns of the same row. Pixels lie row by row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: From frames (n, h, w) and the kept columns by name to frames of any one shape, or to more frames.
Kernel = Callable[[np.ndarray, dict[str, np.ndarray]], np.ndarray]


def stacked(column: pa.Array, height: int, width: int) -> np.ndarray:
    """The frames of a list column as one array; a frame of another size, or none, is an error."""
    lengths = column.value_lengths()
    if column.null_count or (len(column) and (lengths.to_numpy() != height * width).any()):
        raise ValueError(f"every frame must have {height} * {width} pixels")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, height, width)


def lists(frames: np.ndarray) -> pa.ListArray:
    flat = frames.reshape(len(frames), -1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel(), pa.float64()))


def per_frame(frames: DataFrame, values: str, height: int, width: int, kernel: Kernel, keep: Sequence[str]) -> DataFrame:
    """keep, and pixels (array<double>): what the kernel makes of each frame. Kept columns must be numbers or arrays of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                plain = {c: np.stack(batch.column(c).to_pylist()) if pa.types.is_list(batch.column(c).type) else batch.column(c).to_numpy(zero_copy_only=False) for c in keep}
                out = kernel(stacked(batch.column(values), height, width), plain)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), lists(out)], [*keep, "pixels"])

    source = frames.select(*keep, F.col(values).cast("array<double>").alias(values))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.select(*keep).schema.fields)
    return source.mapInArrow(run, f"{schema}, pixels array<double>")


def as_pixels(frames: DataFrame, *keep: str) -> DataFrame:
    """A row for each pixel."""
    return frames.select(*keep, F.posexplode("pixels").alias("pixel", "value")).withColumn("pixel", F.col("pixel").cast("long"))


def summed_images(frames: DataFrame, keys: Sequence[str], values: str) -> DataFrame:
    """keys (numbers), pixels (sums over the key's frames, array<double>) and n, the number of frames.

    Tasks add up their own frames first; sums then meet in a tree of fixed fan-in, so no task gets an image of each task.
    Keys may have images of different sizes, but each key of one size.
    """
    names = [*keys, "part"]
    fields = ", ".join(f"{k} long" for k in names)

    def added(labels: np.ndarray, images: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        kept, place = np.unique(labels, axis=0, return_inverse=True)
        total, count = np.zeros((len(kept), images.shape[1])), np.zeros(len(kept), np.int64)
        np.add.at(total, place.ravel(), images)
        np.add.at(count, place.ravel(), n)
        return pa.RecordBatch.from_arrays([*(pa.array(kept[:, i]) for i in range(len(names))), lists(total), pa.array(count)], [*names, "pixels", "n"])

    def read(rows: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
        column = rows.column("pixels")
        column = column.combine_chunks() if isinstance(rows, pa.Table) else column
        images = column.flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
        return np.stack([rows.column(k).to_numpy().astype(np.int64) for k in names], axis=1), images

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("pixels").value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(sizes):
                same = batch.filter(pa.array(sizes == size))
                yield added(*read(same), np.ones(same.num_rows, np.int64))

    def again(rows: pa.Table) -> pa.Table:
        return pa.Table.from_batches([added(*read(rows), rows["n"].to_numpy())])

    source = frames.select(*(F.col(k).cast("long").alias(k) for k in keys), F.spark_partition_id().cast("long").alias("part"), F.col(values).cast("array<double>").alias("pixels"))
    sums = source.mapInArrow(first, f"{fields}, pixels array<double>, n long")
    for shift in (0, 6, 6, 40):  # a task's batches, then 64 tasks, then 4,096, then all
        sums = sums.withColumn("part", F.shiftright("part", shift)).groupBy(*names).applyInArrow(again, f"{fields}, pixels array<double>, n long")
    return sums.drop("part")


def mean_images(frames: DataFrame, keys: Sequence[str], values: str) -> DataFrame:
    """keys and pixels, the mean of the key's frames."""
    return summed_images(frames, keys, values).select(*keys, F.transform("pixels", lambda v: v / F.col("n")).alias("pixels"))


# ---- kernels


def halved(frames: np.ndarray, taper: bool) -> np.ndarray:
    """Means of 2 by 2 blocks. What sticks out of the image at odd edges counts as missing, or with taper as 0."""
    n, h, w = frames.shape
    padded = np.zeros((n, h + h % 2, w + w % 2))
    padded[:, :h, :w] = frames
    sums = padded.reshape(n, (h + 1) // 2, 2, (w + 1) // 2, 2).sum((2, 4))
    if taper:
        return sums / 4
    rows, columns = np.full((h + 1) // 2, 2.0), np.full((w + 1) // 2, 2.0)
    rows[-1] -= h % 2
    columns[-1] -= w % 2
    return sums / (rows[:, None] * columns)


def box_sums(frames: np.ndarray, before: int, after: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the square from `before` pixels before each pixel to `after` behind it, as far as it lies in the image, and
    how many pixels that are; by sums over corners."""
    n, h, w = frames.shape
    sums = np.zeros((n, h + 1, w + 1))
    sums[:, 1:, 1:] = frames.cumsum(1).cumsum(2)
    y0, y1 = np.maximum(np.arange(h) - before, 0), np.clip(np.arange(h) + after + 1, 0, h)
    x0, x1 = np.maximum(np.arange(w) - before, 0), np.clip(np.arange(w) + after + 1, 0, w)
    box = sums[:, y1][:, :, x1] - sums[:, y0][:, :, x1] - sums[:, y1][:, :, x0] + sums[:, y0][:, :, x0]
    return box, (y1 - y0)[:, None] * (x1 - x0)


def box_mean(frames: np.ndarray, half: int) -> np.ndarray:
    """Mean of the 2 half + 1 square around each pixel, as far as it lies in the image."""
    box, count = box_sums(frames, half, half)
    return box / count


def box_high_pass(frames: np.ndarray, half: int) -> np.ndarray:
    return frames - box_mean(frames, half)


def _even(window: int) -> tuple[int, int]:
    if window <= 0 or window % 2:
        raise ValueError(f"a window must be even and above 0, not {window}")
    return window // 2 - 1, window // 2


def smoothed(frames: np.ndarray, window: int) -> np.ndarray:
    """Means over an even window, one pixel further behind than before, zeros beyond the image."""
    return box_sums(frames, *_even(window))[0] / window**2


def high_passed(frames: np.ndarray, window: int) -> np.ndarray:
    """Frames less their means over an even window, as far as it lies in the image."""
    box, count = box_sums(frames, *_even(window))
    return frames - box / count


def without_background(frames: np.ndarray, size: int) -> np.ndarray:
    """Frames less their means over a square of any size (an even one reaches further before), as far as it lies in the image."""
    box, count = box_sums(frames, size // 2, (size - 1) // 2)
    return frames - box / count


def square_response(frames: np.ndarray, size: int) -> np.ndarray:
    """The sum over a square of any size, zeros beyond the image, by its side: of a patch of unit length."""
    return box_sums(frames, size // 2, (size - 1) // 2)[0] / size


def percentile_normalized(frames: np.ndarray, low: float, high: float) -> np.ndarray:
    """Between two percentiles of each frame, clipped to 0 and 1; 0 where these are equal."""
    lo, hi = np.percentile(frames, [low, high], axis=(1, 2))[:, :, None, None]
    wide = hi > lo
    return np.where(wide, np.clip((frames - lo) / np.where(wide, hi - lo, 1), 0, 1), 0)


def translated(frames: np.ndarray, dy: np.ndarray, dx: np.ndarray) -> np.ndarray:
    """Each frame moved circularly against its offset."""
    n, h, w = frames.shape
    y = (np.arange(h) + dy[:, None]) % h
    x = (np.arange(w) + dx[:, None]) % w
    return frames[np.arange(n)[:, None, None], y[:, :, None], x[:, None, :]]


def odd_rows_shifted(frames: np.ndarray, offset: int) -> np.ndarray:
    """Odd rows moved by `offset` pixels, zeros coming in."""
    out = frames.copy()
    odd = np.zeros_like(frames[:, 1::2])
    w = frames.shape[2]
    if abs(offset) < w:
        source, target = slice(max(0, -offset), w - max(0, offset)), slice(max(0, offset), w + min(0, offset))
        odd[:, :, target] = frames[:, 1::2, source]
    out[:, 1::2] = odd
    return out


def warped(frames: np.ndarray, dy: np.ndarray, dx: np.ndarray) -> np.ndarray:
    """Bilinear samples at each pixel moved by a field. Coordinates are cut toward zero and their neighbours kept inside,
    so samples beyond the first row or column go on in the direction of the edge's slope."""
    n, h, w = frames.shape
    sy, sx = np.arange(h)[:, None] + dy, np.arange(w) + dx
    y0, x0 = np.trunc(sy).astype(int), np.trunc(sx).astype(int)
    fy, fx = sy - y0, sx - x0
    k = np.arange(n)[:, None, None]
    at = lambda y, x: frames[k, np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)]
    return (at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx) * (1 - fy) + (at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx) * fy


def taper_mask(height: int, width: int, slope: float) -> np.ndarray:
    """1 in the middle, falling to the edges along a sigmoid each way, whose middle lies two slopes inside the edge."""
    def side(n: int) -> np.ndarray:
        apart = np.abs(np.arange(n) - (n - 1) / 2)
        return 1 / (1 + np.exp((apart - ((n - 1) / 2 - 2 * slope)) / slope))

    return side(height)[:, None] * side(width)


def tapered(frames: np.ndarray, mask: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Frames faded to a mean where the mask falls."""
    return frames * mask + np.reshape(mean, (-1, 1, 1)) * (1 - mask)


def first_square(height: int, width: int, y: int, x: int, size: int) -> np.ndarray:
    """A size by size patch around a pixel, cut to the image, of unit length as a vector."""
    out = np.zeros((height, width))
    out[max(0, y - size // 2) : max(0, y - size // 2 + size), max(0, x - size // 2) : max(0, x - size // 2 + size)] = 1
    return out / max(1e-12, np.sqrt((out * out).sum()))


def local_median(frames: np.ndarray, half: int) -> np.ndarray:
    """Median of the 2 half + 1 square around each pixel, zeros beyond the image."""
    padded = np.pad(frames, ((0, 0), (half, half), (half, half)))
    windows = np.lib.stride_tricks.sliding_window_view(padded, (2 * half + 1, 2 * half + 1), axis=(1, 2))
    return np.median(windows, axis=(3, 4))


def enhanced(frames: np.ndarray, diameter: float, low: float = -6.0, high: float = 6.0) -> np.ndarray:
    """Mean images less their local median, over the local median of what is left, between two limits as 0 to 1."""
    half = 2 * int(np.ceil(diameter))
    left = frames - local_median(frames, half)
    return np.clip((left / (local_median(np.abs(left), half) + 1e-10) - low) / (high - low), 0, 1)
