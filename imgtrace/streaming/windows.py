"""Windows over event time, on streams and on tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _timed(events: DataFrame, ts: str, delay: str) -> DataFrame:
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return timed.withWatermark(ts, delay) if events.isStreaming else timed


def counted(events: DataFrame, ts: str, width: str, kind: str, value: str, *keep: str) -> DataFrame:
    """Count and sum of each tumbling window and kind; on a stream, late by an hour at most."""
    grouped = _timed(events, ts, "1 hour").groupBy(F.window(ts, width).alias("w"), kind, *keep).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return grouped.select(F.col("w.start").cast("timestamp_ntz").alias("start"), kind, "n", "total", *keep)


def sessions(events: DataFrame, key: str, ts: str, value: str, gap: str, *keep: str) -> DataFrame:
    """Start, count and sum of each key's sessions, which end after a gap; on a stream, late by a gap at most."""
    grouped = _timed(events, ts, gap).groupBy(F.session_window(ts, gap).alias("w"), key, *keep).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return grouped.select(key, F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "total", *keep)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or in local mode one of our own under the warehouse."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"
    return shared.rstrip("/")


def closed(spark: SparkSession, path: str, ts: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Runs a stream over all files there are, then over one row far in the future, which closes every window, and gives them all.

    Windows come out in append mode, each once, when the watermark passes its end, so state holds open windows only. The
    closing row carries a flag, by which `build` must group and which it must keep as `closing`.
    """
    out = f"{shared_folder(spark)}/imgtrace-stream-{uuid.uuid4().hex}"
    table = spark.read.parquet(path)
    flagged = table.withColumn("closing", F.lit(False)).schema
    spark.createDataFrame([], flagged).write.parquet(f"{out}/closing")
    events = spark.readStream.schema(table.schema).parquet(path).withColumn("closing", F.lit(False))
    result = build(events.unionByName(spark.readStream.schema(flagged).parquet(f"{out}/closing")))

    def run() -> None:
        stream = result.writeStream.format("parquet").option("path", f"{out}/table").option("checkpointLocation", f"{out}/state").outputMode("append")
        stream.trigger(availableNow=True).start().awaitTermination()

    run()
    last = table.agg((F.max(F.col(ts).cast("timestamp")) + F.expr("interval 3650 days")).alias("at"))
    columns = [F.col("at").cast(f.dataType).alias(f.name) if f.name == ts else (F.lit(True) if f.name == "closing" else F.lit(None).cast(f.dataType)).alias(f.name) for f in flagged.fields]
    last.where("at is not null").select(*columns).write.mode("append").parquet(f"{out}/closing")
    run()
    return spark.read.schema(result.schema).parquet(f"{out}/table").where("not closing").drop("closing")


def tumbling(spark: SparkSession, path: str, ts: str, width: str, kind: str, value: str) -> DataFrame:
    """All windows of a stream over the files of `path`."""
    return closed(spark, path, ts, lambda events: counted(events, ts, width, kind, value, "closing"))


def streamed_sessions(spark: SparkSession, path: str, key: str, ts: str, value: str, gap: str) -> DataFrame:
    """All sessions of a stream over the files of `path`."""
    return closed(spark, path, ts, lambda events: sessions(events, key, ts, value, gap, "closing"))
