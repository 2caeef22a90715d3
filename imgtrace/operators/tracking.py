"""Sequential steps over regions: clustering across recordings, and removal of overlapping regions.

Pairs and counts come from joins. What has to go in order goes on by connected groups of regions, one in a task: regions
that no chain of overlaps connects can't change each other's result.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from imgtrace.operators.graphs import checkpointed, components
from imgtrace.operators.masks import consensus, large_enough

APART = 10_000.0


def complete_linkage(distance: np.ndarray, cut: float) -> np.ndarray:
    """Cluster numbers from 0 by complete linkage, merging while the closest two clusters are not farther apart than `cut`."""
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    label = np.arange(len(d))
    while len(d) > 1:
        i, j = divmod(int(np.argmin(d)), len(d))
        if d[i, j] > cut:
            break
        i, j = min(i, j), max(i, j)
        d[i] = d[:, i] = np.maximum(d[i], d[j])
        d[j], d[:, j], d[i, i] = np.inf, np.inf, np.inf
        label[label == label[j]] = label[i]
    return np.unique(label, return_inverse=True)[1]


def linked(near: dict[int, dict[int, float]], cut: float) -> list[list[int]]:
    """Members of each cluster by complete linkage over sparse distances; those that `near` lacks are farther than any cut.

    `near` holds each member, and each distance both ways. The closest clusters merge first, ties by their least members.
    """
    near = {k: dict(v) for k, v in near.items()}
    held = {k: [k] for k in near}
    queue = [(d, i, j) for i, others in near.items() for j, d in others.items() if i < j]
    heapq.heapify(queue)
    while queue:
        d, i, j = heapq.heappop(queue)
        if d > cut:
            break
        if i not in held or j not in held or near[i].get(j) != d:
            continue
        both = {k: max(near[i][k], near[j][k]) for k in near[i].keys() & near[j].keys()}
        for gone in (i, j):
            for k in near[gone]:
                near[k].pop(gone, None)
        held[i] = sorted(held[i] + held.pop(j))
        del near[j]
        near[i] = both
        for k, far in both.items():
            near[k][i] = far
            heapq.heappush(queue, (far, min(i, k), max(i, k)))
    return [held[k] for k in sorted(held)]


def _nearness(nodes: Iterable[int], edges: Iterable[tuple[int, int, float]]) -> dict[int, dict[int, float]]:
    near: dict[int, dict[int, float]] = {k: {} for k in nodes}
    for a, b, d in edges:
        if a in near and b in near:
            near[a][b] = near[b][a] = d
    return near


def clusters(members: DataFrame, bin: str, recording: str, roi: str, pixel: str, cut: float) -> DataFrame:
    """bin, roi and cluster (from 0 in each bin): regions of different recordings, by one less their Jaccard overlap (`cut` below 1).

    Pairs meet on their pixels, and only those within the cut go on; each connected group of regions is clustered by itself.
    """
    rows = members.select(F.struct(F.col(bin).cast("long").alias("bin"), F.col(roi).cast("long").alias("roi")).alias("key"), F.col(recording).alias("recording"), F.struct(bin, pixel).alias("pixel")).distinct()
    pairs = checkpointed(_distances(rows.select(F.col("key").alias("roi"), "recording", "pixel"), cut))
    every = rows.select("key", "key.bin", "key.roi").distinct()
    grouped = components(pairs)
    groups = every.join(grouped.withColumnRenamed("node", "key"), "key", "left").select("bin", "roi", F.coalesce("component.roi", "roi").alias("component"))
    links = pairs.join(grouped.withColumnRenamed("node", "a"), "a").select(F.col("component.bin").alias("bin"), F.col("component.roi").alias("component"), F.col("a.roi").alias("a"), F.col("b.roi").alias("b"), "d")

    def run(found: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        near = _nearness(found["roi"].tolist(), zip(edges["a"], edges["b"], edges["d"], strict=True))
        held = linked(near, cut)
        return pd.DataFrame([(found["bin"].iloc[0], r, c[0]) for c in held for r in c], columns=["bin", "roi", "least"])

    out = groups.groupBy("bin", "component").cogroup(links.groupBy("bin", "component")).applyInPandas(run, "bin long, roi long, least long")
    return out.select("bin", "roi", (F.dense_rank().over(Window.partitionBy("bin").orderBy("least")) - 1).cast("long").alias("cluster"))


def _distances(masks: DataFrame, cut: float, within: Column | None = None, *place: str) -> DataFrame:
    """a, b and d (one less the Jaccard overlap, `cut` below 1) of regions (roi, recording, pixel, and a place) of different recordings, up to `cut`.

    Pairs meet on the pixels that they share, and `within` tests their places (named with _a and _b) there; regions that
    share none are apart by 1, so near ones without overlap never become rows.
    """
    side = lambda name: masks.select(F.col("roi").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in ("recording", *place)), "pixel")
    met = side("a").join(side("b"), "pixel").where("a < b and recording_a <> recording_b")
    counted = (met if within is None else met.where(within)).groupBy("a", "b").agg(F.count("*").alias("shared"))
    sizes = masks.groupBy("roi").agg(F.count("*").alias("n"))
    size = lambda name: sizes.select(F.col("roi").alias(name), F.col("n").alias(f"n_{name}"))
    sized = counted.join(size("a"), "a").join(size("b"), "b")
    return sized.select("a", "b", (1 - F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))).alias("d")).where(F.col("d") <= cut)


def tracked(regions: DataFrame, masks: DataFrame, step: int, margin: int, distance: float, cut: float, least: int, height: int, width: int) -> DataFrame:
    """roi, recording, cluster (its least region), by and bx of the regions (roi, recording, y, x) that are found again.

    Bins of step by step pixels take their turns row by row. A bin clusters the regions that it reaches, `margin` pixels
    beyond its edges too, and that no bin before has taken: by complete linkage of Jaccard distances between regions of
    different recordings whose centres lie closer than `distance`. It takes the clusters with regions of `least`
    recordings (2 at least) and their middle in the bin. Distances over `cut` (below 1) never merge, so groups that no
    chain of smaller ones connects can't touch each other in any bin: each connected group goes through its bins by
    itself, in their order, with distances only. A group is as large as one stretch of touching regions.
    """
    if least < 2 or cut >= 1:
        raise ValueError("a cluster needs regions of two recordings, and a cut below 1")
    held = masks.select("roi", "pixel").distinct().join(regions.select("roi", "recording", "y", "x"), "roi")
    squared = F.pow(F.col("y_a") - F.col("y_b"), 2) + F.pow(F.col("x_a") - F.col("x_b"), 2)
    pairs = checkpointed(_distances(held, cut, squared < distance * distance, "y", "x"))
    grouped = components(pairs)
    nodes = regions.join(grouped.withColumnRenamed("node", "roi"), "roi").select("component", "roi", "recording", F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"))
    links = pairs.join(grouped.withColumnRenamed("node", "a"), "a").select(F.col("component").alias("of"), "a", "b", "d")

    def run(found: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        place = {r: (y, x, rec) for r, y, x, rec in zip(found["roi"], found["y"], found["x"], found["recording"], strict=True)}
        reach = defaultdict(list)
        for r, (y, x, _) in sorted(place.items()):
            for by in range(max(0, math.floor((y - step - margin) / step) + 1), min((height - 1) // step, math.ceil((y + margin) / step) - 1) + 1):
                for bx in range(max(0, math.floor((x - step - margin) / step) + 1), min((width - 1) // step, math.ceil((x + margin) / step) - 1) + 1):
                    reach[by, bx].append(r)
        every = _nearness(place, zip(edges["a"], edges["b"], edges["d"], strict=True))
        taken, out = set(), []
        for (by, bx), reached in sorted(reach.items()):
            free = {r for r in reached if r not in taken}
            for c in linked({r: {k: d for k, d in every[r].items() if k in free} for r in sorted(free)}, cut):
                middle = np.mean([place[r][:2] for r in c], axis=0) // step
                if len({place[r][2] for r in c}) >= least and tuple(middle) == (by, bx):
                    taken.update(c)
                    out += [(r, place[r][2], c[0], by, bx) for r in c]
        return pd.DataFrame(out, columns=["roi", "recording", "cluster", "by", "bx"])

    return nodes.groupBy("component").cogroup(links.groupBy("of")).applyInPandas(run, "roi long, recording long, cluster long, by long, bx long")


def templates(found: DataFrame, masks: DataFrame, percent: int, least: int) -> DataFrame:
    """cluster, pixel, holders and weight of tracked clusters' shared masks (roi, pixel, weight): the pixels that enough of
    their regions hold, of clusters with `least` pixels that no other cluster has."""
    shared = consensus(found.select("roi", "cluster").join(masks, "roi"), "cluster", "roi", "pixel", "weight", percent)
    return shared.join(large_enough(shared, "cluster", "pixel", least).select("cluster"), "cluster", "left_semi")


def without_overlapping(masks: DataFrame, plane: str, roi: str, pixel: str, most: float) -> DataFrame:
    """plane and roi of the regions that stay: from the last to the first, one goes if more than `most` of its pixels lie in others that are still there.

    Counts of holders only fall, so a region within the limit at the start stays. The others hang on each other only
    through pixels that two of them hold, so each connected group of these takes its turns by itself. Only these pixels
    travel, a row a region; pixels that a region holds alone, or only with settled ones, are numbers.
    """
    key = F.struct(F.col(plane).cast("long").alias("plane"), F.col(roi).cast("long").alias("roi"))
    rows = masks.select(key.alias("key"), F.struct(plane, pixel).alias("pixel"))
    holders = rows.withColumn("holders", F.count("*").over(Window.partitionBy("pixel")))
    crowded = F.sum(F.when(F.col("holders") > 1, 1).otherwise(0)).over(Window.partitionBy("key")) > most * F.count("*").over(Window.partitionBy("key"))
    judged = checkpointed(holders.withColumn("open", crowded))
    at_pixel = Window.partitionBy("pixel")
    contested = F.count("*").over(at_pixel) > 1
    open_rows = judged.where("open").select("key", "pixel", "holders", contested.alias("contested"), F.min("key").over(at_pixel).alias("first"))
    grouped = components(open_rows.where("contested").select(F.col("key").alias("a"), F.col("first").alias("b")))
    cell = F.struct(F.col(f"pixel.{pixel}").cast("long").alias("pixel"), F.col("holders").cast("int").alias("holders"))
    turns = open_rows.groupBy("key").agg(F.count("*").alias("n"), F.count(F.when(~F.col("contested") & (F.col("holders") > 1), 1)).alias("always"), F.collect_list(F.when(F.col("contested"), cell)).alias("cells"))
    joined = turns.join(grouped.withColumnRenamed("node", "key"), "key", "left").select(F.coalesce("component", "key").alias("component"), "key.plane", "key.roi", "n", "always", "cells")

    def run(rows: pa.Table) -> pa.Table:
        name, n, always = (rows[c].to_numpy() for c in ("roi", "n", "always"))
        cells = rows["cells"].combine_chunks()
        ends = np.concatenate([[0], np.cumsum(cells.value_lengths().to_numpy())])
        flat = cells.flatten()
        pixels, place = np.unique(flat.field("pixel").to_numpy(), return_inverse=True)
        count = np.zeros(len(pixels), np.int32)
        count[place] = flat.field("holders").to_numpy()
        kept = []
        for k in np.argsort(-name):
            own = place[ends[k] : ends[k + 1]]
            if (count[own] > 1).sum() + always[k] > most * n[k]:
                np.subtract.at(count, own, 1)
            else:
                kept.append(k)
        return rows.select(["plane", "roi"]).take(pa.array(kept, pa.int64()))

    stay = judged.where("not open").select("key.plane", "key.roi").distinct()
    return stay.union(joined.groupBy("component").applyInArrow(run, "plane long, roi long"))


def in_bins(rois: DataFrame, y: str, x: str, step: int, margin: int, height: int, width: int) -> DataFrame:
    """A row for each bin of step by step pixels, by and bx, that holds the region's centre or has it less than `margin` beyond its edge."""

    def reached(at: str, length: int) -> Column:
        first = F.greatest(F.floor((F.col(at) - step - margin) / step) + 1, F.lit(0))
        last = F.least(F.ceil((F.col(at) + margin) / step) - 1, F.lit((length - 1) // step))
        return F.when(first <= last, F.sequence(first.cast("long"), last.cast("long")))

    return rois.withColumn("by", F.explode(reached(y, height))).withColumn("bx", F.explode(reached(x, width)))


def accepted(members: DataFrame, step: int, least: int) -> DataFrame:
    """by, bx, cluster and roi of clusters (by, bx, cluster, roi, recording, y, x) that are kept as templates.

    A cluster must have regions of `least` recordings and its middle in its own bin, not only in the margin. A region
    that several such clusters hold goes to the first bin, row by row; the others lose it.
    """
    own = lambda at, bin: (F.avg(at) >= F.col(bin) * step) & (F.avg(at) < (F.col(bin) + 1) * step)
    clusters = members.groupBy("by", "bx", "cluster").agg(F.countDistinct("recording").alias("n"), own("y", "by").alias("oy"), own("x", "bx").alias("ox"))
    kept = members.join(clusters.where((F.col("n") >= least) & F.col("oy") & F.col("ox")).select("by", "bx", "cluster"), ["by", "bx", "cluster"])
    return kept.groupBy("roi").agg(F.min(F.struct("by", "bx", "cluster")).alias("first")).select("first.by", "first.bx", "first.cluster", "roi")
