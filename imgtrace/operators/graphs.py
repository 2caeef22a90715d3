"""Connected components of tables of links, and tables that cut a lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """df from the folder in spark.checkpoint.dir, which all executors share; in local mode without it, from one under the warehouse."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared")
    return df.checkpoint()


def components(links: DataFrame) -> DataFrame:
    """node and component (the least node that links reach) of the nodes in links (a, b) of any orderable type.

    In each round a node, and the node it points to, take the least that a neighbour points to; then everyone points where
    the node it points to does. Rounds grow with the logarithm of a component's size, and a node with very many links is
    only aggregated, never gathered.
    """
    both = checkpointed(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a <> b").distinct())
    labels = checkpointed(both.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node")))
    while True:
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        told = labels.join(around, "node")
        offers = labels.union(told.select("node", "near")).union(told.select("component", "near"))
        hooked = offers.groupBy("node").agg(F.min("component").alias("component"))
        above = hooked.select(F.col("node").alias("component"), F.col("component").alias("higher"))
        jumped = checkpointed(hooked.join(above, "component").select("node", F.col("higher").alias("component")))
        before = labels.select("node", F.col("component").alias("was"))
        if jumped.join(before, "node").where("component <> was").isEmpty():
            return jumped
        labels = jumped
