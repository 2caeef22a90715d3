"""Names, paths and checks of acquisition settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def plane_specifier(plane: Column) -> Column:
    return F.concat(F.lit("plane_"), plane.cast("string"))


def parse_plane_specifier(text: Column) -> Column:
    """The plane of a specifier, null where the prefix or the digits are missing."""
    return F.when(text.rlike("^plane_[0-9]+$"), F.regexp_extract(text, "([0-9]+)$", 1)).try_cast("int")


def dataset_path(root: Column, name: Column) -> Column:
    return F.concat_ws("/", root, F.lit("multi_recording"), F.lower(name))


def relocated(path: Column, old: Column, new: Column) -> Column:
    """The path with its old prefix replaced, where it has it."""
    return F.when(F.startswith(path, old), F.concat(new, F.substr(path, F.length(old) + 1))).otherwise(path)


def line_blocks(lines: DataFrame, region: str, line: str) -> DataFrame:
    """First, last and count of each region's lines, whether they are contiguous, and how they lie to the region before."""
    blocks = lines.groupBy(F.col(region).alias("roi")).agg(F.min(line).alias("first"), F.max(line).alias("last"), F.countDistinct(line).alias("n"))
    before = F.lag("last").over(Window.orderBy("roi"))
    relation = F.when(before.isNull(), "first").when(F.col("first") <= before, "overlap").when(F.col("first") > before + 1, "gap").otherwise("adjacent")
    return blocks.withColumns({"contiguous": F.col("n") == F.col("last") - F.col("first") + 1, "relation": relation})


def broken_rules(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key, whether each rule is broken, and how many are."""
    return rows.select(key, *(c.alias(n) for n, c in rules.items()), sum((c.cast("int") for c in rules.values()), F.lit(0)).alias("errors"))
