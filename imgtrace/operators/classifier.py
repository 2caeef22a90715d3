"""Classification of regions from binned log-odds of their features: naive over features, or weighed by a logistic layer."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from imgtrace.operators.graphs import checkpointed
from imgtrace.operators.movies import weighted_in_time


def quantile_edges(training: DataFrame, features: list[str], bins: int) -> dict[str, Column]:
    """For each feature an array of its edges, found when the query runs."""
    shares = F.array(*(F.lit(k / bins) for k in range(1, bins)))
    return {f: training.agg(F.percentile(f, shares)).scalar() for f in features}


def bin_of(feature: str, edges: Column, bins: int) -> Column:
    """Bin of a value among its edges; null and NaN count as the lowest."""
    value = F.col(feature).cast("double")
    place = sum((F.coalesce(value >= F.get(edges, k), F.lit(False)).cast("int") for k in range(bins - 1)), F.lit(0))
    return F.when(value.isNull() | F.isnan(value), 0).otherwise(place)


def bin_log_odds(training: DataFrame, label: str, feature: str, edges: Column, bins: int) -> DataFrame:
    share = F.avg(F.col(label).cast("double"))
    return training.groupBy(bin_of(feature, edges, bins).alias("bin")).agg((F.ln(share + 1e-6) - F.ln(1 - share + 1e-6)).alias("odds"))


def score(rows: DataFrame, training: DataFrame, key: str, label: str, features: list[str], bins: int) -> DataFrame:
    """key and the sum of its features' log-odds; tables of odds have at most `bins` rows."""
    edges = quantile_edges(training, features, bins)
    out = rows.select(key, *features)
    for f in features:
        odds = bin_log_odds(training, label, f, edges[f], bins).select(F.col("bin").alias(f"bin_{f}"), F.col("odds").alias(f"odds_{f}"))
        out = out.withColumn(f"bin_{f}", bin_of(f, edges[f], bins)).join(F.broadcast(odds), f"bin_{f}", "left")
    total = sum((F.coalesce(f"odds_{f}", F.lit(0.0)) for f in features), F.lit(0.0))
    return out.select(key, total.alias("score"))


# ---- smoothed grids under a logistic layer


def _by_feature(rows: DataFrame, features: list[str], *keep: str) -> DataFrame:
    """A row for each feature, with its value, or null where it is missing or NaN."""
    pairs = F.array(*(F.struct(F.lit(f).alias("feature"), F.nanvl(F.col(f).cast("double"), F.lit(None)).alias("value")) for f in features))
    return rows.select(*keep, F.inline(pairs))


def probability_grid(training: DataFrame, key: str, label: str, features: list[str], nodes: int = 100, sigma: float = 2.0) -> DataFrame:
    """feature and grid, an array of (bin, node, share): values at evenly spaced ranks, and the share of label 1 between
    a node and the next, smoothed over bins; the last node, the greatest value, has no share.

    Ties go by key. Missing values are left out. The windows sort one feature each: training rows are a curated table.
    """
    order = Window.partitionBy("feature")
    ranked = _by_feature(training, features, key, label).where("value is not null")
    ranked = ranked.withColumns({"k": F.row_number().over(order.orderBy("value", key)) - 1, "n": F.count("*").over(order)})
    last = nodes - 1
    place = F.when(F.col("k") < F.col("n") - 1, F.floor((last * (F.col("k") + 1) - 1) / (F.col("n") - 1))).otherwise(last)
    bins = ranked.groupBy("feature", place.cast("long").alias("bin")).agg(F.min("value").alias("node"), F.avg(F.col(label).cast("double")).alias("share"))
    smooth = weighted_in_time(bins.where(F.col("bin") < last), "feature", "bin", "share", sigma, int(4 * sigma + 0.5))
    joined = bins.select("feature", "bin", "node").join(smooth.select("feature", "bin", F.col("smooth").alias("share")), ["feature", "bin"], "left")
    return joined.groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("bin", "node", "share"))).alias("grid"))


def grid_log_odds(rows: DataFrame, grid: DataFrame, key: str, features: list[str]) -> DataFrame:
    """key, feature and odds; missing values count as the lowest. The grid has a row of bounded size for each feature, so it is broadcast."""
    nodes = grid.select("feature", F.col("grid.node").alias("nodes"), F.col("grid.share").alias("shares"), F.element_at("grid.node", -1).alias("top"))
    held = _by_feature(rows, features, key).join(F.broadcast(nodes), "feature").withColumn("limit", F.least("value", "top"))
    below = F.size(F.filter("nodes", lambda node: node < F.col("limit")))
    placed = held.withColumn("bin", F.when(F.col("value").isNull(), 0).otherwise(F.greatest(F.least(below, F.size("nodes") - 1) - 1, F.lit(0))))
    found = placed.withColumn("share", F.get("shares", F.col("bin")))
    return found.select(key, "feature", (F.ln(F.col("share") + 1e-6) - F.ln(1 - F.col("share") + 1e-6)).alias("odds"))


def weighed(labelled: DataFrame) -> DataFrame:
    """odds, label and n, the number of rows that have them; kept in a table, since a fit reads it often."""
    return checkpointed(labelled.groupBy("odds", "label").agg(F.count("*").cast("double").alias("n")))


def classified(rows: DataFrame, training: DataFrame, key: str, label: str, features: list[str], threshold: float = 0.5, nodes: int = 100, strength: float = 100.0) -> DataFrame:
    """key, probability and is_cell of every row, by a logistic regression on the features' log-odds; training needs `nodes` rows.

    The intercept is penalised like the weights, so it is the weight of a constant feature here. Spark passes over features
    that never vary, so each row is also there turned round, features and label, which leaves the mean loss as it is.
    Rows of equal log-odds and label go in once, weighed by their number, so the fit's passes don't grow with the rows
    once their combinations of bins are all there. Keys must not be null.
    """
    n = training.count()
    if n < nodes:
        raise ValueError(f"training needs at least {nodes} rows")
    grid = probability_grid(training, key, label, features, nodes)

    def odds(table: DataFrame) -> DataFrame:
        wide = grid_log_odds(table, grid, key, features).groupBy(key).pivot("feature", features).agg(F.first("odds"))
        return wide.select(key, F.array(*(F.col(f"`{f}`") for f in features), F.lit(1.0)).alias("odds"))

    vectors = lambda table: table.withColumn("features", array_to_vector("odds"))
    plain = weighed(odds(training).join(training.select(key, F.col(label).cast("double").alias("label")), key))
    turned = plain.withColumns({"odds": F.transform("odds", lambda v: -v), "label": 1 - F.col("label")})
    labelled = vectors(plain.unionByName(turned))
    model = LogisticRegression(regParam=1.0 / (strength * n), fitIntercept=False, standardization=False, maxIter=200, tol=1e-9, weightCol="n").fit(labelled)
    probability = vector_to_array("probability")[1]
    return model.transform(vectors(odds(rows))).select(key, probability.alias("probability"), (probability > threshold).alias("is_cell"))
