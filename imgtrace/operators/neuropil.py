"""Surrounds of regions: rings of pixels that no region and no inner border holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imgtrace.operators.masks import dilated, free_lines, line_pixels


def _grown(masks: DataFrame, region: str, pixel: str, width: int, height: int, steps: int) -> DataFrame:
    return reduce(lambda m, _: dilated(m, region, pixel, width, height), range(steps), masks.select(region, pixel))


def surrounds(masks: DataFrame, region: str, pixel: str, width: int, height: int, inner: int, reach: int) -> DataFrame:
    """Pixels of each region's bounding box grown by `reach`, without all regions' pixels and the region's own inner border; a region beyond the image has none."""
    y, x = F.floor(F.col(pixel) / width).cast("long"), (F.col(pixel) % width).cast("long")
    box = masks.groupBy(region).agg(F.min(y).alias("y0"), F.max(y).alias("y1"), F.min(x).alias("x0"), F.max(x).alias("x1"))
    low = [F.greatest(F.col(c) - reach, F.lit(0)).alias(c) for c in ("y0", "x0")]
    high = [F.least(F.col(c) + reach, F.lit(n - 1)).alias(c) for c, n in (("y1", height), ("x1", width))]
    inside = box.select(region, *low, *high).where("y0 <= y1 and x0 <= x1")
    lines = inside.select(region, F.explode(F.sequence("y0", "y1")).alias("y"), "x0", "x1")
    return line_pixels(free_lines(lines, [(_grown(masks, region, pixel, width, height, inner), [region]), (masks, [])], pixel, width), pixel, width)


def surround_means(surround: DataFrame, movie: DataFrame, region: str, pixel: str, frame: str, value: str) -> DataFrame:
    """Mean of the movie over each region's surround, by frame; a region without a surround has no rows, its trace counts as 0."""
    return surround.join(movie, pixel).groupBy(region, frame).agg(F.avg(value).alias("f"))
