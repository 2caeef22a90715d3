"""Connected components of a table of links, by alternating large and small stars.

Each step points nodes at the least node they know, by aggregation and joins only, so a node with very many links is
never gathered in one place. Every step is written to the shared folder; steps grow with the logarithm of a component's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imgtrace.llm.common import materialize


def _star(links: DataFrame, large: bool) -> DataFrame:
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both if large else both.where("b < a")
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    pointed = near.join(least, "a")
    if large:
        out = pointed.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = pointed.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def downward(links: DataFrame) -> DataFrame:
    """Links (a, b) with a > b, each once."""
    return links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def one_step(links: DataFrame) -> DataFrame:
    """Downward links that connect what these connect, nearer to stars around least nodes."""
    return materialize(_star(_star(links, True), False))


def least_known(links: DataFrame) -> DataFrame:
    """node and component (a node that it is connected to, the least it points to) of the nodes that point to another."""
    return links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))


def components(links: DataFrame) -> DataFrame:
    """node and component (the least node that links reach) of the nodes in `links` (a, b); nodes without links are left out."""
    now, seen = one_step(downward(links)), None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
        now = one_step(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b")).distinct())
