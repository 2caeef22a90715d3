"""Statistics, selection and classification of regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ellipse(masks: DataFrame, region: str, y: str, x: str, weight: str) -> DataFrame:
    """Radii of the weighted covariance ellipse (2.5 standard deviations), radius and aspect ratio."""
    w, fy, fx = F.col(weight), F.col(y), F.col(x)
    sums = masks.groupBy(region).agg(*(F.sum(c).alias(n) for n, c in (("w", w), ("wy", w * fy), ("wx", w * fx), ("wyy", w * fy * fy), ("wxx", w * fx * fx), ("wyx", w * fy * fx))))
    my, mx = F.col("wy") / F.col("w"), F.col("wx") / F.col("w")
    a, b, c = F.col("wyy") / F.col("w") - my * my, F.col("wxx") / F.col("w") - mx * mx, F.col("wyx") / F.col("w") - my * mx
    half, root = (a + b) / 2, F.sqrt(F.pow((a - b) / 2, 2) + c * c)
    radii = sums.select(region, (2.5 * F.sqrt(F.greatest(half + root, F.lit(0.0)))).alias("major"), (2.5 * F.sqrt(F.greatest(half - root, F.lit(0.0)))).alias("minor"))
    return radii.withColumn("aspect_ratio", 2 * F.col("major") / (F.col("major") + F.col("minor") + 0.01))


def mean_radius(masks: DataFrame, region: str, y: str, x: str) -> DataFrame:
    """Mean distance of a region's pixels from the medians of their coordinates."""
    middle = masks.groupBy(region).agg(F.percentile(y, F.lit(0.5)).alias("my"), F.percentile(x, F.lit(0.5)).alias("mx"), F.count("*").alias("n"))
    apart = F.sqrt(F.pow(F.col(y) - F.col("my"), 2) + F.pow(F.col(x) - F.col("mx"), 2))
    return masks.join(middle, region).groupBy(region).agg(F.avg(apart).alias("radius"), F.first("n").alias("pixels"))


def compactness(masks: DataFrame, region: str, y: str, x: str) -> DataFrame:
    """Mean radius over that of a disc of as many pixels, 1 at least."""
    disc = F.lit(2.0 / 3.0) * F.sqrt(F.col("pixels") / F.pi())
    return mean_radius(masks, region, y, x).withColumn("compactness", F.greatest(F.lit(1.0), F.col("radius") / (1e-10 + disc)))


def diameter(rois: DataFrame, pixels: str, default: int = 10) -> DataFrame:
    """One row: the diameter of a disc of the median pixel count, 1 at least; the default without regions."""
    median = F.percentile(pixels, F.lit(0.5))
    return rois.agg(F.when(F.count(pixels) > 0, F.greatest(F.lit(1), F.floor(2 * F.sqrt(median / F.pi())))).otherwise(default).cast("long").alias("diameter"))


def normalized_size(rois: DataFrame, region: str, pixels: str, first: int = 100) -> DataFrame:
    """Adds `normalized`: the pixel count over the mean of the first regions'."""
    mean = rois.orderBy(region).limit(first).agg(F.avg(pixels)).scalar()
    return rois.withColumn("normalized", F.col(pixels) / mean)


def select(rois: DataFrame, probability: str, pixels: str, x: str, borders: list[float], least: float, most: int, margin: float) -> DataFrame:
    """Regions with enough probability and not too many pixels, off the borders by more than the margin."""
    clear = F.forall(F.array(*(F.lit(float(b)) for b in borders)), lambda b: F.abs(F.col(x) - b) > margin) if borders else F.lit(True)
    return rois.where((F.col(probability) >= least) & (F.col(pixels) <= most) & clear)


def top(rois: DataFrame, by: str, region: str, count: int) -> DataFrame:
    """The first regions by a statistic, null as 0, greatest first, ties by region."""
    return rois.orderBy(F.coalesce(F.col(by), F.lit(0)).desc(), region).limit(min(count, 500))


def grid_log_odds(rows: DataFrame, label: str, feature: str, bins: int) -> DataFrame:
    """Per quantile bin of a feature: rows, share of label 1, and its log-odds (shares kept off 0 and 1)."""
    edges = rows.agg(F.percentile(feature, F.array(*(F.lit(k / bins) for k in range(1, bins))))).scalar()
    place = sum(((F.col(feature) >= F.get(edges, k)).cast("int") for k in range(bins - 1)), F.lit(0))
    share = F.least(F.greatest(F.avg(F.col(label).cast("double")), F.lit(1e-3)), F.lit(1 - 1e-3))
    return rows.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), share.alias("share")).withColumn("log_odds", F.ln(F.col("share") / (1 - F.col("share"))))


def natural_key(name: Column) -> Column:
    """A key that sorts numbers in names by value."""
    parts = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(p)), "")


def unique_component(paths: DataFrame, path: str) -> DataFrame:
    """For each path the last of its parts that no other path has, or null."""
    parts = paths.select(F.col(path).alias("path"), F.posexplode(F.split(path, "/")).alias("place", "part"))
    held = parts.groupBy("part").agg(F.countDistinct("path").alias("paths")).where("paths = 1 and part <> ''")
    own = parts.join(held, "part").groupBy("path").agg(F.max_by("part", "place").alias("component"))
    return paths.select(F.col(path).alias("path")).distinct().join(own, "path", "left")
