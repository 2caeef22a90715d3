"""Fields of offsets between recordings: inverted, chained, and masks and images carried along them both ways.

A field says for each pixel how far away the pixel lies that it takes its value from. A recording's field is two images of
fixed size, so it stays one row of arrays; only where masks meet it on pixels does it become rows, and then by one join.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imgtrace.operators.frames import lists, stacked, warped
from imgtrace.operators.masks import moved_by_field

ROUNDS, CLOSE = 50, 1e-4


def inverse(dy: np.ndarray, dx: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """The fields that lead back: each offset is less the offset found where it leads, in rounds until they stand still.

    They settle where a field's slope is below 1 everywhere, so where no two pixels swap sides.
    """
    back_y, back_x = -dy, -dx
    for _ in range(rounds):
        y, x = -_sampled(dy, back_y, back_x), -_sampled(dx, back_y, back_x)
        moved = max(np.abs(y - back_y).max(initial=0), np.abs(x - back_x).max(initial=0))
        back_y, back_x = y, x
        if moved < CLOSE:
            break
    return back_y, back_x


def _sampled(values: np.ndarray, dy: np.ndarray, dx: np.ndarray) -> np.ndarray:
    """Bilinear samples at each pixel moved by a field, edges repeated."""
    _, h, w = values.shape
    y = np.clip(np.arange(h)[:, None] + dy, 0, h - 1) - np.arange(h)[:, None]
    x = np.clip(np.arange(w) + dx, 0, w - 1) - np.arange(w)
    return warped(values, y, x)


def chained(first: tuple[np.ndarray, np.ndarray], second: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One field for two: a pixel goes along `first`, and from there along `second`."""
    return tuple(a + _sampled(b, *first) for a, b in zip(first, second, strict=True))


def _mapped(fields: DataFrame, height: int, width: int, columns: list[str], f: Callable[..., tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                out = f(*(stacked(batch.column(c), height, width) for c in columns))
                yield pa.RecordBatch.from_arrays([batch.column("recording"), *map(lists, out)], ["recording", "dy", "dx"])

    return fields.select(F.col("recording").cast("long").alias("recording"), *columns).mapInArrow(run, "recording long, dy array<double>, dx array<double>")


def inverted(fields: DataFrame, height: int, width: int) -> DataFrame:
    """recording, dy and dx of the fields (recording, dy, dx: arrays) that lead back."""
    return _mapped(fields, height, width, ["dy", "dx"], inverse)


def composed(first: DataFrame, second: DataFrame, height: int, width: int) -> DataFrame:
    """recording, dy and dx of each recording's two fields, one after the other."""
    both = first.join(second.select("recording", F.col("dy").alias("then_dy"), F.col("dx").alias("then_dx")), "recording")
    return _mapped(both, height, width, ["dy", "dx", "then_dy", "then_dx"], lambda a, b, c, d: chained((a, b), (c, d)))


def warped_images(images: DataFrame, fields: DataFrame, height: int, width: int) -> DataFrame:
    """recording and pixels of each recording's image (recording, pixels) seen along its field."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                pixels, dy, dx = (stacked(batch.column(c), height, width) for c in ("pixels", "dy", "dx"))
                yield pa.RecordBatch.from_arrays([batch.column("recording"), lists(_sampled(pixels, dy, dx))], ["recording", "pixels"])

    return images.join(fields, "recording").select(F.col("recording").cast("long").alias("recording"), "pixels", "dy", "dx").mapInArrow(run, "recording long, pixels array<double>")


def _as_rows(fields: DataFrame) -> DataFrame:
    zipped = fields.select("recording", F.posexplode(F.arrays_zip("dy", "dx")).alias("pixel", "offset"))
    return zipped.select("recording", F.col("pixel").cast("long").alias("pixel"), "offset.dy", "offset.dx")


def into_common(regions: DataFrame, fields: DataFrame, height: int, width: int) -> DataFrame:
    """recording, roi, pixel and weight of each recording's regions (recording, roi, pixel, weight) in the common view."""
    return moved_by_field(regions, _as_rows(fields), "recording", height, width)


def into_recordings(templates: DataFrame, fields: DataFrame, height: int, width: int) -> DataFrame:
    """recording, cluster, pixel and weight of common templates (cluster, pixel, weight) as each recording sees them.

    Fields lead from the recordings into the common view, as for into_common; their inverses are taken here. One join on
    the pixel brings templates to all recordings, so only what arrives becomes rows.
    """
    nearest = lambda at, offset: F.floor(at + F.col(offset) + 0.5)
    rows = _as_rows(inverted(fields, height, width))
    y, x = nearest(F.floor(F.col("pixel") / width), "dy"), nearest(F.col("pixel") % width, "dx")
    aimed = rows.where((y >= 0) & (y < height) & (x >= 0) & (x < width)).select("recording", F.col("pixel").alias("target"), (y * width + x).cast("long").alias("pixel"))
    return templates.where("weight <> 0").join(aimed, "pixel").select("recording", "cluster", F.col("target").alias("pixel"), "weight")


def summary(placed: DataFrame, key: str, width: int) -> DataFrame:
    """recording, key, pixels, radius (of a disc of as many pixels) and the median row and column of moved masks."""
    middle = lambda at: F.floor(F.percentile(at, F.lit(0.5))).cast("long")
    return placed.groupBy("recording", key).agg(
        F.count("*").alias("pixels"), F.sqrt(F.count("*") / F.pi()).alias("radius"), middle(F.floor(F.col("pixel") / width)).alias("y"), middle(F.col("pixel") % width).alias("x")
    )
