"""Helpers that the corpus operators share."""

from __future__ import annotations

import contextlib
import uuid
import weakref
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words, as a Java and Python character class: space and the controls from tab to carriage return.
WORD_BREAKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or, in local mode only, one of our own under the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"
    return found.rstrip("/")


def _file_system(spark: SparkSession, path: str) -> tuple:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


@contextlib.contextmanager
def rows_a_batch(spark: SparkSession, most: int) -> Iterator[None]:
    """Arrow batches of so many rows at most for what is planned within: for rows so large that Spark's usual count would fill memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialize(df: DataFrame, row_group: int | None = None) -> DataFrame:
    """Writes df to a table in the shared folder and reads it again, which cuts the lineage and survives lost executors.

    Readers take up row groups as a whole; row_group is their size in bytes for tables of large rows. The files go by
    forget(), or when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/imgtrace-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer if row_group is None else writer.option("parquet.block.size", row_group)).parquet(path)
    system, target = _file_system(spark, path)
    system.deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = (weakref.ref(out), path)
    return out


_paths: dict[int, tuple[weakref.ref, str]] = {}


def forget(table: DataFrame) -> None:
    """Deletes the files of a table from materialize(), which nothing reads any more."""
    known, path = _paths.pop(id(table), (None, ""))
    if known is not None and known() is table:
        system, target = _file_system(table.sparkSession, path)
        system.delete(target, True)


def pieces_of(batch: pa.RecordBatch, column: str = "text", most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about `most` bytes of text each, and one row at least."""
    start = size = 0
    lengths = pc.binary_length(batch.column(batch.schema.get_field_index(column))).to_pylist()
    for i, n in enumerate(lengths):
        if size and size + (n or 0) > most:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n or 0
    if start < len(lengths):
        yield batch.slice(start)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def list_array(values: pa.Array, lengths: list[int]) -> pa.ListArray:
    """A list array whose rows take so many of the values each."""
    offsets = [0]
    for n in lengths:
        offsets.append(offsets[-1] + n)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
