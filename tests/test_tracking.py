"""Tracking and greedy removal by connected groups, against loops over all regions in order."""

import random
from collections import Counter, defaultdict

import numpy as np

from imgtrace.operators import graphs, tracking


def test_components_of_chains_stars_and_rings(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    links = [*chain, *((7, i) for i in range(500, 700)), (1, 2), (2, 3), (3, 1), (9, 9), (2, 1), (620, 141)]
    got = {r.node: r.component for r in graphs.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 7 for i in [7, 141, *range(500, 700)]}, 1: 1, 2: 1, 3: 1}
    assert graphs.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sparse_linkage_is_the_dense_one():
    rng = np.random.default_rng(2)
    for n in (2, 5, 12, 25):
        for _ in range(20):
            d = rng.choice([0.1, 0.2, 0.3, 0.4, 0.5, 1e4], (n, n))
            d = np.minimum(d, d.T)
            near = {i: {j: d[i, j] for j in range(n) if j != i and d[i, j] < 1} for i in range(n)}
            want = defaultdict(list)
            for i, c in enumerate(tracking.complete_linkage(d, 0.35)):
                want[c].append(i)
            assert sorted(tracking.linked(near, 0.35)) == sorted(want.values())


def _moved_cells(seed, cells, recordings, side, spread):
    """Squares around cells' places, moved a little in each recording."""
    rng = random.Random(seed)
    regions, masks = [], []
    for cell in range(cells):
        cy, cx = rng.randrange(4, side - 4), rng.randrange(4, side - 4)
        for rec in range(recordings):
            if rng.random() < 0.8:
                y, x, roi = cy + rng.randint(-spread, spread), cx + rng.randint(-spread, spread), len(regions)
                y, x = min(max(y, 3), side - 4), min(max(x, 3), side - 4)
                regions.append((roi, rec, float(y), float(x)))
                masks += [(roi, (y + dy) * side + x + dx, 1.0 + abs(dy)) for dy in range(-2, 3) for dx in range(-2, 3) if rng.random() < 0.9]
    return regions, masks


def _plain_tracked(regions, masks, step, margin, distance, cut, least, side):
    pixels = defaultdict(set)
    for roi, p, _ in masks:
        pixels[roi].add(p)
    taken, out = {}, []
    for by in range((side - 1) // step + 1):
        for bx in range((side - 1) // step + 1):
            inside = lambda v, b: b * step - margin < v < b * step + step + margin
            here = [r for r in regions if r[0] not in taken and inside(r[2], by) and inside(r[3], bx)]
            d = np.full((len(here), len(here)), 1e4)
            for i, a in enumerate(here):
                for j, b in enumerate(here[:i]):
                    if a[1] != b[1] and (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 < distance**2:
                        shared = len(pixels[a[0]] & pixels[b[0]])
                        d[i, j] = d[j, i] = 1 - shared / (len(pixels[a[0]]) + len(pixels[b[0]]) - shared)
            label = tracking.complete_linkage(d, cut) if here else []
            for c in sorted(set(label)):
                group = [r for r, k in zip(here, label) if k == c]
                my, mx = np.mean([r[2] for r in group]), np.mean([r[3] for r in group])
                if len({r[1] for r in group}) >= least and by * step <= my < by * step + step and bx * step <= mx < bx * step + step:
                    for r in group:
                        taken[r[0]] = group[0][0]
                        out.append((r[0], r[1], group[0][0], by, bx))
    return sorted(out)


def test_tracking_is_the_loop_over_bins(spark):
    for seed, cells, side, spread in ((1, 660, 200, 1), (2, 120, 60, 2)):
        regions, masks = _moved_cells(seed, cells, 4, side, spread)
        want = _plain_tracked(regions, masks, 20, 9, 8, 0.75, 2, side)
        table = spark.createDataFrame(regions, "roi long, recording long, y double, x double")
        held = spark.createDataFrame(masks, "roi long, pixel long, weight double")
        found = tracking.tracked(table, held, 20, 9, 8, 0.75, 2, side, side)
        assert sorted(map(tuple, found.collect())) == want and len(want) > 100
    assert len(regions) > 300


def test_templates_are_what_enough_regions_hold(spark):
    regions, masks = _moved_cells(3, 40, 4, 60, 1)
    table = spark.createDataFrame(regions, "roi long, recording long, y double, x double")
    held = spark.createDataFrame(masks, "roi long, pixel long, weight double")
    found = tracking.tracked(table, held, 20, 9, 8, 0.75, 3, 60, 60)
    groups = defaultdict(list)
    for r in found.collect():
        groups[r.cluster].append(r.roi)
    want = {}
    for c, rois in groups.items():
        count, weight = Counter(), Counter()
        for roi, p, w in masks:
            if roi in rois:
                count[p] += 1
                weight[p] += w
        want |= {(c, p): (n, weight[p] / n) for p, n in count.items() if 2 * n >= len(rois)}
    over = Counter(p for _, p in want)
    own = Counter(c for c, p in want if over[p] == 1)
    got = {(r.cluster, r.pixel): (r.holders, round(r.weight, 9)) for r in tracking.templates(found, held, 50, 6).collect()}
    assert got == {k: (n, round(w, 9)) for k, (n, w) in want.items() if own[k[0]] >= 6} and len(got) > 50


def _plain_without(rows, most):
    out = set()
    for plane in {p for p, _, _ in rows}:
        masks = defaultdict(list)
        for p, r, x in rows:
            if p == plane:
                masks[r].append(x)
        count = Counter(x for m in masks.values() for x in m)
        for r in sorted(masks, reverse=True):
            if sum(count[x] > 1 for x in masks[r]) > most * len(masks[r]):
                count.subtract(masks[r])
            else:
                out.add((plane, r))
    return out


def test_greedy_removal_is_the_loop_over_a_plane(spark):
    rng = random.Random(4)
    for most, side in ((0.5, 60), (0.2, 40), (0.0, 200), (1.0, 30)):
        rows = []
        for plane in range(3):
            for roi in range(80):
                y, x, h, w = rng.randrange(side), rng.randrange(side), rng.randint(2, 6), rng.randint(2, 6)
                rows += [(plane, roi, (y + dy) * 1000 + x + dx) for dy in range(h) for dx in range(w)]
        out = tracking.without_overlapping(spark.createDataFrame(rows, "plane long, roi long, pixel long"), "plane", "roi", "pixel", most)
        assert {(r.plane, r.roi) for r in out.collect()} == _plain_without(rows, most)


def test_removal_sends_a_row_a_region(spark):
    """Pixels alone, held with settled regions, and contested ones, over many regions; only a row a region meets the others."""
    rng = np.random.default_rng(21)
    rows = sorted({(p, r, int(x)) for p in range(2) for r in range(p, 60, 2) for x in rng.integers(0, 200 if r < 30 else 3000, 25)})
    for most in (0.0, 0.3, 0.6):
        out = tracking.without_overlapping(spark.createDataFrame(rows, "plane long, roi long, pixel long"), "plane", "roi", "pixel", most)
        assert {tuple(r) for r in out.collect()} == _plain_without(rows, most)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "FlatMapGroupsInPandas" not in plan
