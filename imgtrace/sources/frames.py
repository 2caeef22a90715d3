"""Movies on disk: Parquet tables of frames, and raw files of 16-bit pixels without a header."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MOST = 32766  # the largest value that is written


def write_frames(frames: DataFrame, path: str) -> None:
    """Writes (recording_id, plane, channel, frame, h, w, pixels), values capped at MOST, one folder for each movie."""
    capped = frames.withColumn("pixels", F.transform("pixels", lambda v: F.least(v, F.lit(MOST)).cast("short")))
    capped.write.partitionBy("recording_id", "plane", "channel").mode("append").parquet(path)


def read_frames(spark: SparkSession, path: str, recording: str | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """Frames of all movies or of one recording, from start up to but without end; both filters reach the scan."""
    out = spark.read.parquet(path)
    if recording is not None:
        out = out.where(F.col("recording_id") == recording)
    if start is not None:
        out = out.where(F.col("frame") >= start)
    return out if end is None else out.where(F.col("frame") < end)


class _Range(InputPartition):
    def __init__(self, start: int, end: int) -> None:
        self.start, self.end = start, end


class _Reader(DataSourceReader):
    def __init__(self, path: str, height: int, width: int, batch: int) -> None:
        self.path, self.height, self.width, self.batch = path, height, width, batch

    def partitions(self) -> list[InputPartition]:
        frames = os.path.getsize(self.path) // (2 * self.height * self.width)
        return [_Range(k, min(frames, k + self.batch)) for k in range(0, frames, self.batch)] or [_Range(0, 0)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        size = self.height * self.width
        with open(self.path, "rb") as f:
            f.seek(2 * size * partition.start)
            for k in range(partition.start, partition.end):
                yield k, self.height, self.width, np.frombuffer(f.read(2 * size), "<i2").tolist()


class RawMovie(DataSource):
    """spark.read.format("raw_movie").option("height", h).option("width", w).load(file): a row for each frame, `batch` frames a partition."""

    @classmethod
    def name(cls) -> str:
        return "raw_movie"

    def schema(self) -> str:
        return "frame int, h int, w int, pixels array<smallint>"

    def reader(self, schema) -> DataSourceReader:
        o = self.options
        return _Reader(o["path"], int(o["height"]), int(o["width"]), int(o.get("batch", 500)))
