"""From regions to traces: masks without shared pixels, surrounds grown until they are large enough, sums and means by frame."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from imgtrace.operators.masks import dilated, free_lines, line_pixels

STEP, MOST_ROUNDS = 5, 100
#: Places of the image (whole lines, one at least) and frames of the movie that meet in a task, and regions whose places are there at once.
PLACES, FRAMES, REGIONS = 4096, 64, 256


def built_masks(masks: DataFrame, region: str, pixel: str, weight: str, with_shared: bool) -> DataFrame:
    """region, pixel and share: weights that sum to 1, of the pixels that no other region holds unless shared ones are wanted."""
    holders = F.count("*").over(Window.partitionBy(pixel))
    own = masks.select(region, pixel, weight) if with_shared else masks.select(region, pixel, weight, holders.alias("holders")).where("holders = 1")
    return own.select(region, pixel, (F.col(weight) / F.sum(weight).over(Window.partitionBy(region))).alias("share"))


def _free_before(held: np.ndarray) -> np.ndarray:
    """Counts of free pixels above and left of each corner."""
    out = np.zeros((held.shape[0] + 1, held.shape[1] + 1), np.int64)
    out[1:, 1:] = (~held).cumsum(0).cumsum(1)
    return out


def grown_box(free: np.ndarray, box: tuple[int, int, int, int], taken: int, start: int, least: int) -> tuple[int, int, int, int]:
    """The box (y0, y1, x0, x1, ends exclusive), grown by STEP each way as often as it has `least` free pixels or fewer besides those taken.

    `start` is the count of free pixels before the first round.
    """
    h, w = free.shape[0] - 1, free.shape[1] - 1
    y0, y1, x0, x1 = box
    count = start
    for _ in range(MOST_ROUNDS):
        if count - taken > least:
            break
        y0, y1, x0, x1 = max(0, y0 - STEP), min(h, y1 + STEP), max(0, x0 - STEP), min(w, x1 + STEP)
        count = int(free[y1, x1] - free[y0, x1] - free[y1, x0] + free[y0, x0])
    return y0, y1, x0, x1


def surrounds(masks: DataFrame, plane: str, region: str, pixel: str, height: int, width: int, border: int, least: int) -> DataFrame:
    """plane, region and pixel of each region's surround, as `surround_lines` finds them."""
    return line_pixels(surround_lines(masks, plane, region, pixel, height, width, border, least), pixel, width).select(plane, region, pixel)


def surround_lines(masks: DataFrame, plane: str, region: str, pixel: str, height: int, width: int, border: int, least: int) -> DataFrame:
    """plane, region, y and xs, the places in a line, of each region's surround, as `surround_boxes` finds them."""
    grown, inner, held = surround_boxes(masks, plane, region, pixel, height, width, border, least)
    lines = grown.select(plane, region, "x0", (F.col("x1") - 1).alias("x1"), F.explode(F.sequence("y0", F.col("y1") - 1)).alias("y"))
    return free_lines(lines, [(inner, [plane, region]), (held, [plane])], pixel, width).select(plane, region, "y", "xs")


def surround_boxes(masks: DataFrame, plane: str, region: str, pixel: str, height: int, width: int, border: int, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each region's surround as a box (plane, region, y0, y1, x0, x1, ends exclusive) less its own grown pixels and the held ones (the second and third table): a box grown until more than `least` of its pixels are free.

    Free are pixels that no region of the plane holds; those of the region grown by `border` do not count and do not belong
    to the surround. A plane is an image of fixed size, and only its held pixels and its regions' boxes meet in a task, to
    count free pixels by sums over corners. Pixels beyond the image hold nothing, and a region that has no others has no
    surround.
    """
    rows = masks.select(plane, region, F.col(pixel).cast("long").alias(pixel)).distinct()
    key = F.struct(plane, region)
    inner = rows.select(key.alias("key"), pixel)
    for _ in range(border):
        inner = dilated(inner, "key", pixel, width, height)
    inner = inner.select(F.col(f"key.{plane}").alias(plane), F.col(f"key.{region}").alias(region), pixel)
    held = rows.where(F.col(pixel).between(0, height * width - 1)).select(plane, pixel).distinct()
    y, x = F.floor(F.col(pixel) / width).cast("long"), F.col(pixel) % width
    flagged = inner.join(held.withColumn("held", F.lit(True)), [plane, pixel], "left")
    boxes = flagged.groupBy(plane, region).agg(F.min(y).alias("y0"), (F.max(y) + 1).alias("y1"), F.min(x).alias("x0"), (F.max(x) + 1).alias("x1"), F.count(F.when(F.col("held").isNull(), 1)).alias("taken"))

    def grow(found: pa.Table, pixels: pa.Table) -> pa.Table:
        image = np.zeros(height * width, bool)
        image[pixels[pixel].to_numpy()] = True
        free = _free_before(image.reshape(height, width))
        # Before the first round a region's own grown pixels are its box, so none of them is left besides those taken.
        ends = [grown_box(free, (r["y0"], r["y1"], r["x0"], r["x1"]), r["taken"], r["taken"], least) for r in found.to_pylist()]
        columns = [pa.array([e[k] for e in ends], pa.int64()) for k in range(4)]
        return pa.table([found[plane], found[region], *columns], names=[plane, region, "y0", "y1", "x0", "x1"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(plane, region).schema.fields)
    grown = boxes.groupBy(plane).cogroup(held.groupBy(plane)).applyInArrow(grow, f"{schema}, y0 long, y1 long, x0 long, x1 long")
    return grown, inner, held


def surround_means(grown: DataFrame, inner: DataFrame, held: DataFrame, movie: DataFrame, plane: str, region: str, pixel: str, frame: str, value: str, height: int, width: int) -> DataFrame:
    """region, frame and neuropil: means of the movie's values over surrounds as `surround_boxes` gives them; places without a value don't count.

    The image is cut into strips of lines. A strip's boxes and taken pixels meet its part of FRAMES frames of the movie in
    one task, as a product of matrices, so neither pixels of surrounds nor lists of them are made.
    """
    lines = max(1, PLACES // width)
    size = lines * width
    strip, place = F.floor(F.col(pixel) / size).cast("long").alias("strip"), (F.col(pixel) % size).cast("long").alias("place")
    inside = F.col(pixel).between(0, height * width - 1)
    cells = movie.where(inside & F.col(value).isNotNull()).select(strip, F.floor(F.col(frame) / FRAMES).cast("long").alias("chunk"), place, frame, F.col(value).cast("double").alias("value"))
    strips = F.sequence(F.floor(F.col("y0") / lines).cast("long"), F.floor((F.col("y1") - 1) / lines).cast("long"))
    boxes = grown.select(F.explode(strips).alias("strip"), plane, region, "y0", "y1", "x0", "x1")
    areas = boxes.unionByName(inner.select(strip, plane, region, place), allowMissingColumns=True).unionByName(held.select(strip, plane, place), allowMissingColumns=True)
    dealt = areas.crossJoin(F.broadcast(cells.select(F.col("chunk").alias("part")).distinct()))

    def sums(key: tuple[pa.Scalar, ...], values: pa.Table, areas: pa.Table) -> pa.Table:
        frames = values[frame].combine_chunks().dictionary_encode()
        n = len(frames.dictionary)
        at = values["place"].to_numpy() * n + frames.indices.to_numpy()
        total = np.bincount(at, values["value"].to_numpy(), size * n).reshape(size, n)
        # The movie beside the counts of its values.
        both = np.hstack([total, np.bincount(at, minlength=size * n).reshape(size, n)])
        odd = np.flatnonzero(~np.isfinite(both).all(axis=0))
        names = areas[region].combine_chunks().dictionary_encode()
        found, codes = [np.zeros(0, np.int64)], names.indices.fill_null(-1).to_numpy()
        out = [np.zeros((0, 2 * n))]
        planes, own = np.unique(areas[plane].to_numpy(), return_inverse=True)
        is_box = areas["y0"].is_valid().to_numpy()
        taken = areas["place"].fill_null(-1).to_numpy()
        ends = np.stack([areas[c].fill_null(0).to_numpy() for c in ("y0", "y1", "x0", "x1")])
        ends[:2] -= key[0].as_py() * lines
        order = np.argsort(own, kind="stable")
        for here in np.split(order, np.searchsorted(own[order], np.arange(1, len(planes)))):
            free = np.ones(size, bool)
            free[taken[here[codes[here] < 0]]] = False
            here = here[np.argsort(codes[here], kind="stable")]
            boxes, pixels = here[is_box[here]], here[~is_box[here] & (codes[here] >= 0)]
            for part in (boxes[k : k + REGIONS] for k in range(0, len(boxes), REGIONS)):
                y0, y1, x0, x1 = ends[:, part, None]
                y, x = (np.arange(lines) >= y0) & (np.arange(lines) < y1), (np.arange(width) >= x0) & (np.arange(width) < x1)
                holds = (y[:, :, None] & x[:, None, :]).reshape(len(part), size) & free
                mine = pixels[np.searchsorted(codes[pixels], codes[part[0]]) : np.searchsorted(codes[pixels], codes[part[-1]], "right")]
                holds[np.searchsorted(codes[part], codes[mine]), taken[mine]] = False
                with np.errstate(invalid="ignore"):
                    got = holds.astype(float) @ both
                for k in range(len(part) if len(odd) else 0):  # a product would carry what is not finite into all regions
                    got[k, odd] = both[np.ix_(holds[k], odd)].sum(axis=0)
                found.append(codes[part])
                out.append(got)
        regions, got = np.concatenate(found), np.concatenate(out)
        columns = [names.dictionary.take(pa.array(np.repeat(regions, n))), frames.dictionary.take(pa.array(np.tile(np.arange(n), len(regions))))]
        columns += [pa.array(got[:, :n].ravel()), pa.array(got[:, n:].ravel())]
        return pa.table(columns, names=[region, frame, "total", "n"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in (grown.schema[region], movie.schema[frame]))
    found = cells.groupBy("strip", "chunk").cogroup(dealt.groupBy("strip", "part")).applyInArrow(sums, f"{schema}, total double, n double")
    return found.where("n > 0").groupBy(region, frame).agg((F.sum("total") / F.sum("n")).alias("neuropil"))


def line_means(around: DataFrame, movie: DataFrame, region: str, pixel: str, frame: str, value: str, width: int) -> DataFrame:
    """region, frame and neuropil: means over surrounds (region, y, xs) of the movie's values; places without one don't count.

    A line of the movie is one row of `width` values, so surrounds meet the movie by lines, and no pixel of them is a row.
    """
    y, x = F.floor(F.col(pixel) / width).cast("long"), (F.col(pixel) % width).cast("int")
    ys = around.select("y").distinct()
    cells = movie.select(frame, y.alias("y"), x.alias("x"), F.col(value).cast("double").alias("v")).where("v is not null").join(F.broadcast(ys), "y", "left_semi")
    held = cells.groupBy("y", frame).agg(F.map_from_entries(F.collect_list(F.struct("x", "v"))).alias("by_x"))
    lines = held.select("y", frame, F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.try_element_at("by_x", k)).alias("line"))
    met = around.select(region, "y", "xs").join(lines, "y").select(region, frame, F.transform("xs", lambda k: F.get("line", k.cast("int"))).alias("under"))
    sums = met.select(region, frame, F.aggregate(F.array_compact("under"), F.lit(0.0), lambda total, v: total + v).alias("total"), F.size(F.array_compact("under")).alias("n"))
    return sums.where("n > 0").groupBy(region, frame).agg((F.sum("total") / F.sum("n")).alias("neuropil"))


def traces(built: DataFrame, near: DataFrame, movie: DataFrame, region: str, pixel: str, frame: str, value: str, coefficient: float) -> DataFrame:
    """region, frame, fluorescence, neuropil (0 without a surround; near as `surround_means` gives it) and corrected (less a share of the neuropil)."""
    own = built.join(movie, pixel).groupBy(region, frame).agg(F.sum(F.col("share") * F.col(value)).alias("fluorescence"))
    joined = own.join(near, [region, frame], "left").withColumn("neuropil", F.coalesce("neuropil", F.lit(0.0)))
    return joined.withColumn("corrected", F.col("fluorescence") - coefficient * F.col("neuropil"))


def crop(offsets: DataFrame, plane: str, frame: str, y: str, x: str, correlation: str, listed: str, threshold: float, most_fraction: float, height: int, width: int, half: int) -> DataFrame:
    """plane, frame and bad: listed frames, outliers of their offsets and correlations, and offsets near the greatest allowed.

    An outlier's distance from the running medians of its offsets, over the plane's mean distance, is more than 100
    `threshold` times its correlation over the running median of correlations (0 at least). Medians take zeros beyond the ends.
    """
    near = Window.partitionBy(plane).orderBy(frame).rowsBetween(-half, half)

    def median(c: str):
        window = F.collect_list(c).over(near)
        return F.element_at(F.array_sort(F.concat(window, F.array_repeat(F.lit(0.0), 2 * half + 1 - F.size(window)))), half + 1)

    apart = offsets.withColumns({"apart": F.hypot(F.col(y) - median(y), F.col(x) - median(x)), "usual": median(correlation)})
    mean = F.avg("apart").over(Window.partitionBy(plane))
    scaled = F.when(mean > 0, F.col("apart") / mean).otherwise(F.col("apart"))
    quality = F.greatest(F.lit(0.0), F.col(correlation) / F.nullif(F.col("usual"), F.lit(0.0)))
    outlier = F.when(F.coalesce(quality, F.lit(1.0)) > 0, scaled / F.coalesce(quality, F.lit(1.0)) > 100 * threshold).otherwise(scaled > 0)
    far = (F.abs(y) > 0.95 * most_fraction * height) | (F.abs(x) > 0.95 * most_fraction * width)
    return apart.select(plane, frame, (F.col(listed) | outlier | far).alias("bad"))
