"""Shards in random order by a two-pass external shuffle, in DataFrame functions only.

First pass: every record goes to one of the buckets, each small enough for a task's memory, by a seeded hash of the whole
record. Second pass: a task takes one bucket and permutes its records by a Fisher-Yates shuffle. The buckets one after the
other are then a random order of all records; it is cut into shards of equal numbers of records (at most one apart), so a
bucket's records go to one or two shards, and shards are written without another exchange.

The order of the buckets needs their counts first; these travel to the buckets as records of the same exchange, so no
table of buckets is broadcast. A bucket is the partition of its own number, is sorted before it is permuted, and seeds its
own random numbers, so the result depends on the records, the seed and the size of the buckets alone: neither on how the
input is partitioned nor on tasks that run again.

Defined results: a null text counts 0 bytes; empty and repeated records each get a place of their own; records that are
equal in all columns can take each other's places, and those that occur more than REPEATS times are counted first and then
dealt out copy by copy, so they don't meet in one bucket; a very long text makes its bucket larger by itself; an empty
table gives no rows; columns of the input named shard or slot are replaced. Columns must have an order (no maps).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from imgtrace.llm.common import materialize

#: What a bucket holds in bytes of text. For 100 TB take 1 GB, which makes 100,000 buckets.
BUCKET_BYTES = 16 << 20
#: Equal records beyond this number are dealt out copy by copy.
REPEATS = 100
#: Buckets whose counts are added up in one group, before the groups' sums are.
BUCKET_GROUP = 1024
RECORD_BYTES = 16


def size_of(text: str = "text") -> F.Column:
    return (F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)) + RECORD_BYTES).cast("long")


def _numbered(docs: DataFrame, seed: int) -> DataFrame:
    """low and high (128 bits of hash of a record), copy and record; the copy tells apart records that occur very often."""
    hashed = lambda salt: F.xxhash64(F.lit(seed), F.lit(salt), *docs.columns)
    keyed = docs.select(hashed("low").alias("low"), hashed("high").alias("high"), F.struct(*docs.columns).alias("record"))
    often = materialize(keyed.groupBy("low", "high").agg(F.count("*").alias("n")).where(F.col("n") > REPEATS).select("low", "high"))
    if often.isEmpty():
        return keyed.withColumn("copy", F.lit(0).cast("long"))
    single = keyed.join(often, ["low", "high"], "left_anti").withColumn("copy", F.lit(0).cast("long"))
    counted = keyed.join(often, ["low", "high"], "left_semi").groupBy("low", "high").agg(F.first("record").alias("record"), F.count("*").alias("n"))
    return single.unionByName(counted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("n"))


def _offsets(bucketed: DataFrame) -> DataFrame:
    """bucket and offset, the number of records in the buckets before it; summed within groups of buckets, then over groups."""
    counts = bucketed.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("part", F.floor(F.col("bucket") / BUCKET_GROUP))
    before = lambda window: F.coalesce(F.sum("n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = counts.groupBy("part").agg(F.sum("n").alias("n"))
    parts = parts.select("part", before(Window.orderBy("part")).alias("parts_before"))
    within = counts.select("bucket", "part", before(Window.partitionBy("part").orderBy("bucket")).alias("within"))
    return within.join(parts, "part").select("bucket", (F.col("within") + F.col("parts_before")).alias("offset"))


def shards(docs: DataFrame, n_shards: int, seed: int = 42, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The records with shard (0 to n_shards - 1) and slot (their place there, from 0), in random order."""
    docs = docs.drop("shard", "slot")
    total = docs.agg(F.count("*").alias("n"), F.sum(size_of()).alias("bytes")).first()
    n, buckets = total.n, max(1, -(-(total.bytes or 0) // bucket_bytes))
    bucketed = _numbered(docs, seed).withColumn("bucket", F.pmod(F.xxhash64(F.lit("bucket"), "low", "high", "copy"), F.lit(buckets)).cast("int"))
    offsets = materialize(_offsets(bucketed))
    sent = bucketed.select("bucket", F.lit(None).cast("long").alias("offset"), F.struct("low", "high", "record").alias("record"))
    sent = sent.unionByName(offsets.select("bucket", "offset"), allowMissingColumns=True).repartitionById(buckets, "bucket")
    filled = sent.groupBy("bucket").agg(F.max("offset").alias("offset"), F.sort_array(F.collect_list("record")).alias("records"))
    permuted = filled.select("offset", F.posexplode(F.shuffle("records", seed)).alias("at", "kept"))
    placed = permuted.select(F.col("kept.record").alias("record"), (F.col("offset") + F.col("at")).alias("place"))
    rows = F.lit(max(n, 1)).cast("long")
    shard = F.call_function("div", (F.col("place") + 1) * n_shards - 1, rows)
    return placed.withColumn("shard", shard).select("record.*", F.col("shard").cast("int").alias("shard"), (F.col("place") - F.call_function("div", F.col("shard") * rows, F.lit(n_shards).cast("long"))).alias("slot"))


def write(sharded: DataFrame, path: str) -> None:
    """A folder for each shard; its files, by name, hold its records in the order of their slots."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
