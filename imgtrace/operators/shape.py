"""Shape of regions: centre, soma, compactness against a grid's disc, and solidity.

All but the hull are aggregations and array expressions; a hull needs the region's points together, one region at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from imgtrace.operators import rois, tracking
from imgtrace.operators.graphs import checkpointed

#: Regions of so many pixels at most are all soma, and have a fixed hull area.
SMALL, SMALL_AREA = 10, 10.0


def centres(masks: DataFrame, region: str, y: str, x: str) -> DataFrame:
    """region, cy and cx: the region's own pixel closest to the medians of its coordinates; ties go to the lower row, then column."""
    middle = masks.groupBy(region).agg(F.percentile(y, F.lit(0.5)).alias("my"), F.percentile(x, F.lit(0.5)).alias("mx"))
    apart = F.pow(F.col(y) - F.col("my"), 2) + F.pow(F.col(x) - F.col("mx"), 2)
    best = masks.join(middle, region).groupBy(region).agg(F.min(F.struct(apart.alias("d"), F.col(y).alias("cy"), F.col(x).alias("cx"))).alias("c"))
    return best.select(region, "c.cy", "c.cx")


def disc_radii(spark: SparkSession, most: int) -> DataFrame:
    """pixels and baseline: the mean distance of the `pixels` grid points nearest to a point, for 1 to `most` of them."""
    reach = int(np.ceil(np.sqrt(most / np.pi))) + 2
    side = np.arange(-reach, reach + 1)
    apart = np.sort(np.hypot(side[:, None], side).ravel())[:most]
    means = apart.cumsum() / np.arange(1, most + 1)
    return spark.createDataFrame([(k + 1, float(m)) for k, m in enumerate(means)], "pixels long, baseline double")


def compactness(masks: DataFrame, region: str, y: str, x: str, most: int = 4096) -> DataFrame:
    """region, pixels, radius (mean distance from the centre) and compactness: the radius over that of as many grid points, 1 at least.

    Grid discs are tabled up to `most` pixels; the radius of a plain disc, which they approach, serves larger regions.
    """
    placed = masks.join(centres(masks, region, y, x), region)
    apart = F.hypot(F.col(y) - F.col("cy"), F.col(x) - F.col("cx"))
    sized = placed.groupBy(region).agg(F.count("*").alias("pixels"), F.avg(apart).alias("radius"))
    joined = sized.join(F.broadcast(disc_radii(masks.sparkSession, most)), "pixels", "left")
    baseline = F.coalesce("baseline", F.lit(2.0 / 3.0) * F.sqrt(F.col("pixels") / F.pi()))
    return joined.select(region, "pixels", "radius", F.greatest(F.lit(1.0), F.col("radius") / (baseline + 1e-10)).alias("compactness"))


def soma(masks: DataFrame, region: str, y: str, x: str, weight: str) -> DataFrame:
    """masks with `apart` (distance from the centre) and `soma`: whether the pixel lies inside the region's crop radius.

    The weight between two whole radii tells how dense the region is there. The crop radius is the first after the density
    has risen above a third of its greatest at which it falls below that; without one, and in small regions, none or the last.
    """
    placed = masks.join(centres(masks, region, y, x), region).withColumn("apart", F.hypot(F.col(y) - F.col("cy"), F.col(x) - F.col("cx"))).drop("cy", "cx")
    rings = placed.groupBy(region, F.floor("apart").cast("int").alias("ring")).agg(F.sum(weight).alias("w"), F.count("*").alias("n"))
    # Rings in order; where the next one lies further out, the empty ring in between has no weight.
    after = F.lead("ring").over(Window.partitionBy(region).orderBy("ring"))
    whole = Window.partitionBy(region)
    inside = (F.col("ring") > 0) & F.col("after").isNotNull()  # the last ring does not count
    dense = rings.withColumns({"w": F.coalesce("w", F.lit(0.0)), "after": after}).withColumn("cut", F.max(F.when(inside, F.col("w"))).over(whole) / 3)
    above = dense.withColumn("first", F.min(F.when(inside & (F.col("w") > F.col("cut")), F.col("ring"))).over(whole))
    below = F.when(F.col("w") < F.col("cut"), F.col("ring")).when(F.col("after") > F.col("ring") + 1, F.col("ring") + 1)
    by_region = above.groupBy(region).agg(F.sum("n").alias("n"), F.max("ring").alias("last"), F.max("cut").alias("cut"), F.min(F.when(inside & (F.col("ring") >= F.col("first")), below)).alias("below"))
    radius = F.when((F.col("n") > SMALL) & (F.col("cut") > 0), F.coalesce("below", "last"))
    return placed.join(by_region.select(region, radius.alias("crop")), region).withColumn("soma", F.col("crop").isNull() | (F.col("apart") < F.col("crop"))).drop("crop")


def hull_area(points: np.ndarray) -> float:
    """Area of the convex hull of points (n, 2), 0 if they lie on a line: a chain along the lower side, one along the upper."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return 0.0

    def chain(ordered: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for p in ordered:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    ring = np.array(chain(points) + chain(points[::-1]), float)
    ahead = np.roll(ring, -1, axis=0)
    return abs(float((ring[:, 0] * ahead[:, 1] - ring[:, 1] * ahead[:, 0]).sum())) / 2


def solidity(masks: DataFrame, region: str, y: str, x: str) -> DataFrame:
    """region and solidity: pixels over the area of their hull, or over a fixed area if they are few or on a line."""

    def run(table: pa.Table) -> pa.Table:
        n, area = table.num_rows, 0.0
        if n > SMALL:
            area = hull_area(np.column_stack([table["y"].to_numpy(), table["x"].to_numpy()]))
        return pa.table({"region": table["region"][:1], "solidity": pa.array([n / (area or SMALL_AREA)])})

    source = masks.select(F.col(region).cast("long").alias("region"), F.col(y).cast("double").alias("y"), F.col(x).cast("double").alias("x"))
    return source.groupBy("region").applyInArrow(run, "region long, solidity double").withColumnRenamed("region", region)


# ---- one table


def disc_means(spark: SparkSession, diameter: int) -> DataFrame:
    """pixels and baseline: the mean distance of so many points of a grid, nearest first, out to two diameters each way.

    A region of more pixels takes the mean of them all, so the table is as large as the diameter makes it, not the regions.
    """
    side = np.arange(-2 * diameter, 2 * diameter + 1)
    apart = np.sort(np.hypot(side[:, None], side).ravel())
    means = apart.cumsum() / np.arange(1, len(apart) + 1)
    return spark.createDataFrame(list(zip(range(1, len(means) + 1), means.tolist(), strict=True)), "counted long, baseline double")


def statistics(masks: DataFrame, width: int, diameter: int = 10, aspect: float | None = None, crop: bool = True, most_overlap: float | None = None, first: int = 100) -> DataFrame:
    """A row for each region of masks (plane, roi, y, x, weight; roi unique over planes) with all that describes it.

    cy and cx are its middle pixel, pixels and soma_pixels count it all and within its crop radius; compactness, solidity,
    radius and aspect_ratio are those of the soma (of all pixels without crop), pixels of weight 0 left out of the ellipse;
    overlapping counts the pixels that other regions of the plane hold too; normalized is the soma's size over the mean of
    the plane's first regions. With most_overlap, regions of which more lies in others go first, from the last on, and then
    overlaps are counted among those that stay; sizes are normalized before. `aspect` stretches the rows' scale.
    """
    spark = masks.sparkSession
    keyed = masks.select(*(F.col(c).cast("long").alias(c) for c in ("plane", "roi", "y", "x")), F.col("weight").cast("double").alias("weight"))
    marked = soma(keyed, "roi", "y", "x", "weight")
    inner = checkpointed((marked.where("soma") if crop else marked).select("plane", "roi", "y", "x", "weight"))
    sizes = keyed.groupBy("plane", "roi").agg(F.count("*").alias("pixels")).join(inner.groupBy("roi").agg(F.count("*").alias("soma_pixels")), "roi")
    ranked = sizes.withColumn("_place", F.row_number().over(Window.partitionBy("plane").orderBy("roi")))
    usual = F.avg(F.when(F.col("_place") <= first, F.col("soma_pixels"))).over(Window.partitionBy("plane"))
    sized = ranked.withColumn("normalized", F.col("soma_pixels") / usual).drop("_place")
    discs = disc_means(spark, diameter)
    spread = rois.mean_radius(inner, "roi", "y", "x").withColumn("counted", F.least("pixels", F.lit((4 * diameter + 1) ** 2))).join(F.broadcast(discs), "counted")
    compact = spread.select("roi", F.greatest(F.lit(1.0), F.col("radius") / diameter / (1e-10 + F.col("baseline") / diameter)).alias("compactness"))
    y_scale = int(aspect * diameter) if aspect is not None else diameter
    scaled = inner.where("weight > 0").select("roi", (F.col("y") / y_scale).alias("y"), (F.col("x") / diameter).alias("x"), "weight")
    round_ = rois.ellipse(scaled, "roi", "y", "x", "weight").select("roi", (F.col("major") * ((y_scale + diameter) / 2)).alias("radius"), "aspect_ratio")
    described = sized.join(centres(keyed, "roi", "y", "x"), "roi").join(compact, "roi").join(solidity(inner, "roi", "y", "x"), "roi").join(round_, "roi", "left")
    rows = keyed.select("plane", "roi", (F.col("y") * width + F.col("x")).alias("pixel"))
    if most_overlap is not None and most_overlap < 1:
        stay = tracking.without_overlapping(rows, "plane", "roi", "pixel", most_overlap).select("roi")
        rows = rows.join(stay, "roi", "left_semi")
    held = rows.withColumn("holders", F.count("*").over(Window.partitionBy("plane", "pixel")))
    shared = held.groupBy("roi").agg(F.sum(F.when(F.col("holders") > 1, 1).otherwise(0)).alias("overlapping"))
    return described.join(shared, "roi")
