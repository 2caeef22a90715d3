"""Recordings, planes and their files as rows: names, roots, progress, settings and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---- names and paths


def array_name(name: Column, second: Column) -> Column:
    """The file of an array, with a suffix for the second channel."""
    return F.concat(name, F.when(second, "_channel_2").otherwise(""), F.lit(".npy"))


def array_path(root: Column, plane: Column, name: Column, second: Column) -> Column:
    return F.concat_ws("/", root, F.concat(F.lit("plane_"), plane.cast("string")), array_name(name, second))


def relocation_prefixes(old: Column, new: Column) -> Column:
    """(old, new): what is left of two paths without the parts that they share at their ends."""
    a, b = F.reverse(F.split(old, "/")), F.reverse(F.split(new, "/"))
    equal = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    shared = F.coalesce(F.nullif(F.array_position(equal, False), F.lit(0)), F.size(equal).cast("long") + 1) - 1
    head = lambda parts: F.array_join(F.reverse(F.slice(parts, (shared + 1).cast("int"), F.greatest(F.size(parts) - shared.cast("int"), F.lit(0)))), "/")
    return F.struct(head(a).alias("old"), head(b).alias("new"))


def roots(markers: DataFrame, path: str, place: str, depth: int) -> DataFrame:
    """Distinct folders `depth` levels above the marker files, by the first place at which each comes."""
    parts = F.split(F.col(path), "/")
    above = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - depth, F.lit(0))), "/")
    return markers.groupBy(above.alias("root")).agg(F.min(place).alias("first"))


def region_borders(regions: DataFrame, recording: str, x: str) -> DataFrame:
    """recording and borders: the distinct starts of its regions in ascending order, without the first."""
    starts = regions.groupBy(recording).agg(F.array_sort(F.collect_set(x)).alias("starts"))
    return starts.select(recording, F.slice("starts", F.lit(2), F.greatest(F.size("starts") - 1, F.lit(0))).alias("borders"))


# ---- progress


def plane_progress(planes: DataFrame, files: DataFrame, keys: list[str], kind: str, steps: dict[str, str]) -> DataFrame:
    """keys, a column for each step (whether its file is there), and `reached`, how many steps from the first on are done."""
    there = files.groupBy(*keys).agg(*(F.bool_or(F.col(kind) == f).alias(s) for s, f in steps.items()))
    out = planes.select(*keys).distinct().join(there, keys, "left").withColumns({s: F.coalesce(s, F.lit(False)) for s in steps})
    reached, whole = F.lit(0), F.lit(True)
    for s in steps:
        whole = whole & F.col(s)
        reached = reached + whole.cast("int")
    return out.withColumn("reached", reached)


def dataset_progress(recordings: DataFrame, dataset: str, recording: str, processed: str, tracked: str, place: str, template: str) -> DataFrame:
    """dataset, recordings, how many are processed and extractable, and whether it is discovered: its first recording has the template."""
    flag = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(0))
    return recordings.groupBy(dataset).agg(
        F.countDistinct(recording).alias("recordings"),
        F.sum(flag(processed)).alias("processed"),
        F.sum(flag(tracked)).alias("extractable"),
        F.coalesce(F.min_by(template, place), F.lit(False)).alias("discovered"),
    )


def preferred(saved: DataFrame, raw: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Settings of each key: the saved ones where there are any, else the raw ones, as a whole."""
    own = saved.select(key, F.struct(*fields).alias("saved"))
    other = raw.select(key, F.struct(*fields).alias("raw"))
    joined = own.join(other, key, "full").withColumn("x", F.coalesce("saved", "raw"))
    return joined.select(key, F.when(F.col("saved").isNotNull(), "saved").otherwise("raw").alias("origin"), *(F.col(f"x.{f}").alias(f) for f in fields))


def usable_planes(planes: DataFrame, plane: str, frames: str, flyback: list[int], least: int = 50, few: int = 200) -> DataFrame:
    """Adds `state`: flyback planes and those of fewer than `least` frames are refused, those of fewer than `few` warned of."""
    state = F.when(F.col(plane).isin(flyback), "flyback").when(F.col(frames) < least, "too few frames").when(F.col(frames) < few, "few frames").otherwise("ok")
    return planes.withColumn("state", state)


# ---- conversion of pages


def source_geometry(pages: DataFrame, recording: str, height: str, width: str, kind: str) -> DataFrame:
    """recording, pages, the least height and width, and whether all its pages agree in shape and kind."""
    return pages.groupBy(recording).agg(
        F.count("*").alias("pages"),
        F.min(height).alias("height"),
        F.min(width).alias("width"),
        ((F.min(height) == F.max(height)) & (F.min(width) == F.max(width)) & (F.min(kind) == F.max(kind))).alias("uniform"),
    )


def conversion_plan(geometry: DataFrame, planes: Column, channels: Column, region_rows: Column | None = None) -> DataFrame:
    """Adds cycle, frames (full cycles), left_over pages, plane_height and `state` of converting each recording."""
    cycle = planes * channels
    out = geometry.withColumns({"cycle": cycle, "frames": F.floor(F.col("pages") / cycle).cast("long"), "left_over": F.col("pages") % cycle, "plane_height": region_rows if region_rows is not None else F.col("height")})
    state = F.when(~F.col("uniform"), "pages differ").when(F.col("frames") == 0, "no full cycle").when(F.col("plane_height") > F.col("height"), "rows past the end").when(F.col("left_over") > 0, "last cycle dropped").otherwise("ok")
    return out.withColumn("state", state)


def binary_sizes(planes: DataFrame, size: str, frames: str, height: str, width: str, bytes_a_pixel: int = 2) -> DataFrame:
    """Adds expected (bytes of a raw movie) and fits."""
    expected = F.col(frames).cast("long") * F.col(height) * F.col(width) * bytes_a_pixel
    return planes.withColumn("expected", expected).withColumn("fits", F.col(size) == F.col("expected"))


def row_slice(pixels: Column, width: int, first: Column, last: Column) -> Column:
    """Rows first to last, both included, of an image laid out row by row."""
    return F.slice(pixels, (first * width + 1).cast("int"), ((last - first + 1) * width).cast("int"))


# ---- settings


def expanded_spans(spans: DataFrame, recording: str, region: str, first: str, last: str) -> DataFrame:
    """A row for each line of each span [first, last]; spans that run backwards have none."""
    return spans.where(F.col(first) <= F.col(last)).select(recording, region, F.explode(F.sequence(first, last)).alias("line"))


def bounded_slice(values: Column, start: Column, count: Column) -> Column:
    """`count` values from `start` on (from 0), cut to what there is; nothing for a start past the end."""
    n = F.size(values)
    begin = F.greatest(start, F.lit(0))
    return F.slice(values, (begin + 1).cast("int"), F.greatest(F.least(count, n - begin), F.lit(0)).cast("int"))


def differing(settings: DataFrame, defaults: DataFrame, key: str, name: str, value: str) -> DataFrame:
    """key, name, value and default of the settings that differ from the defaults or that these do not know; nulls are values."""
    known = F.broadcast(defaults.select(F.col(name).alias("of"), F.col(value).alias("default"), F.lit(True).alias("known")))
    joined = settings.join(known, F.col(name) == F.col("of"), "left")
    return joined.where(F.col("known").isNull() | ~F.col(value).eqNullSafe(F.col("default"))).select(key, name, value, "default")


def coerced(text: Column, kind: Column) -> Column:
    """(whole, real, flag) of a setting given as text, by its kind; null where the text is none of that kind."""
    flag = F.when(F.lower(text).isin("true", "yes", "1"), True).when(F.lower(text).isin("false", "no", "0"), False)
    return F.struct(F.when(kind == "int", text.try_cast("long")).alias("whole"), F.when(kind == "float", text.try_cast("double")).alias("real"), F.when(kind == "bool", flag).alias("flag"))


def missing_columns(expected: DataFrame, actual: DataFrame, file: str, column: str) -> DataFrame:
    """file and column of what a table should have and has not; extra columns do not matter."""
    return expected.select(file, column).distinct().join(actual.select(file, column).distinct(), [file, column], "left_anti")


# ---- regions


def fallback_thresholds(recordings: DataFrame, first: dict[str, str]) -> DataFrame:
    """For each column of the second channel (value) the one of the first (key) where it is null."""
    return recordings.withColumns({second: F.coalesce(second, own) for own, second in first.items()})


def layered(masks: DataFrame, region: str, pixel: str, layers: int) -> DataFrame:
    """pixel, layer and region: of the regions that hold a pixel the lowest lie on top, `layers` of them at most."""
    place = F.row_number().over(Window.partitionBy(pixel).orderBy(region)) - 1
    return masks.select(region, pixel).distinct().withColumn("layer", place.cast("long")).where(F.col("layer") < layers)


def flipped(rois: DataFrame, label: str, chosen: Column) -> DataFrame:
    return rois.withColumn(label, F.when(chosen, 1 - F.col(label)).otherwise(F.col(label)))


def scaled_to_percentiles(rois: DataFrame, by: str, value: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Adds `colour`: the value between two percentiles of its group, clipped to 0 and 1; 0 where these are equal."""
    ends = rois.groupBy(by).agg(F.percentile(value, F.lit(low)).alias("lo"), F.percentile(value, F.lit(high)).alias("hi"))
    scaled = F.least(F.greatest((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")), F.lit(0.0)), F.lit(1.0))
    return rois.join(F.broadcast(ends), by).withColumn("colour", F.when(F.col("hi") > F.col("lo"), scaled).otherwise(0.0)).drop("lo", "hi")


def training_rows(rois: DataFrame, label: str, features: list[str]) -> DataFrame:
    """Labelled rows of features: those without a label are left out, missing or not-a-number features are null."""
    clean = [F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")).alias(f) for f in features]
    return rois.where(F.col(label).isNotNull()).select((F.col(label) > 0.5).alias("label"), *clean)


def most_regions(planes: Column, rounds: Column, a_round: int = 250) -> Column:
    """How many regions detection can give."""
    return planes * rounds * a_round


def binned_frames(frames: Column, batch: int, size: int) -> Column:
    """Bins of `size` frames, each batch cut to full bins, one at least for a batch of fewer."""
    rest = frames % batch
    bins = lambda n: F.when(n == 0, 0).when(n > size, F.floor(n / size)).otherwise(1)
    return (F.floor(frames / batch) * bins(F.lit(batch)) + bins(rest)).cast("long")
