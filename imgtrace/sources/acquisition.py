"""Acquisition settings: JSON files read with a schema, planes derived from them, rules they must meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "frame_rate double, plane_number int, channel_number int, roi_number int, roi_lines array<array<int>>, roi_x_coordinates array<int>, roi_y_coordinates array<int>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file; malformed JSON is an error."""
    rows = spark.read.schema(SCHEMA).option("mode", "FAILFAST").option("multiLine", True).json(path)
    return rows.withColumn("file", F.col("_metadata.file_path"))


def rules() -> dict[str, Column]:
    """Name of each rule, and whether a row breaks it."""
    regions = F.coalesce("roi_number", F.lit(1))
    wrong_size = lambda c: F.col(c).isNotNull() & (F.size(c) != regions)
    return {
        "frame_rate_not_positive": ~F.coalesce(F.col("frame_rate") > 0, F.lit(False)),
        "plane_number_not_positive": ~F.coalesce(F.col("plane_number") > 0, F.lit(False)),
        "channel_number_not_positive": ~F.coalesce(F.col("channel_number") > 0, F.lit(False)),
        "roi_lines_count": wrong_size("roi_lines"),
        "roi_x_count": wrong_size("roi_x_coordinates"),
        "roi_y_count": wrong_size("roi_y_coordinates"),
    }


def planes(settings: DataFrame) -> DataFrame:
    """A row for each virtual plane: its number (region times planes plus plane), region, plane and sampling rate."""
    count = F.coalesce("roi_number", F.lit(1)) * F.col("plane_number")
    each = settings.select("file", "plane_number", "frame_rate", F.explode(F.sequence(F.lit(0), count - 1)).alias("virtual_plane"))
    return each.select(
        "file",
        "virtual_plane",
        F.floor(F.col("virtual_plane") / F.col("plane_number")).cast("int").alias("region"),
        (F.col("virtual_plane") % F.col("plane_number")).alias("plane"),
        (F.col("frame_rate") / F.col("plane_number")).alias("sampling_rate"),
    )
