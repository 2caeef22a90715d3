"""The table of regions' statistics against loops over each region's pixels."""

import numpy as np
import pytest
from test_tracking import _plain_without

from imgtrace.operators import shape

SIDE = 60


def _regions(seed, planes, n):
    rng = np.random.default_rng(seed)
    rows = []
    for roi in range(planes * n):
        cy, cx = rng.integers(8, SIDE - 8, 2)
        points = np.unique(np.round(rng.normal((cy, cx), rng.uniform(1, 3), (rng.integers(4, 60), 2))).astype(int).clip(0, SIDE - 1), axis=0)
        rows += [(roi % planes, roi, int(y), int(x), float(max(0, rng.normal(2, 1)))) for y, x in points]
    return rows


def _plain(points, weights, diameter, y_scale):
    """Compactness, radius and aspect ratio of one region's (soma) pixels."""
    y, x = points.T
    spread = np.hypot((y - np.median(y)) / diameter, (x - np.median(x)) / diameter).mean()
    side = np.arange(-2 * diameter, 2 * diameter + 1)
    disc = np.sort(np.hypot(side[:, None], side).ravel() / diameter)[: len(points)].mean()
    held = weights > 0
    w = weights[held] / weights[held].sum()
    scaled = np.stack([y[held] / y_scale, x[held] / diameter])
    centred = scaled - (scaled * w).sum(1, keepdims=True)
    values = np.linalg.eigvalsh((centred * w) @ centred.T)
    minor, major = 2.5 * np.sqrt(np.maximum(values, 0))
    return max(1, spread / (1e-10 + disc)), major * (y_scale + diameter) / 2, 2 * major / (major + minor + 0.01)


@pytest.mark.parametrize(("crop", "aspect", "most"), [(False, None, None), (True, 1.5, 0.4)])
def test_statistics_are_what_loops_give(spark, crop, aspect, most):
    rows = _regions(1, 2, 25)
    table = spark.createDataFrame(rows, "plane long, roi long, y long, x long, weight double")
    got = {r.roi: r for r in shape.statistics(table, SIDE, 10, aspect, crop, most, first=10).collect()}
    somas = {}
    for r in shape.soma(table, "roi", "y", "x", "weight").collect():
        if r.soma or not crop:
            somas.setdefault(r.roi, []).append((r.y, r.x, r.weight))
    stay = {roi for _, roi in _plain_without([(p, roi, y * SIDE + x) for p, roi, y, x, _ in rows], most)} if most else {r[1] for r in rows}
    assert set(got) == stay and (most is None or len(stay) < 50)
    for roi, r in got.items():
        own = [q for q in rows if q[1] == roi]
        inner = np.array(somas[roi])
        compactness, radius, ratio = _plain(inner[:, :2], inner[:, 2], 10, 15 if aspect else 10)
        assert (r.plane, r.pixels, r.soma_pixels) == (own[0][0], len(own), len(inner))
        assert r.compactness == pytest.approx(compactness) and r.radius == pytest.approx(radius) and r.aspect_ratio == pytest.approx(ratio)
        area = shape.hull_area(inner[:, :2]) if len(inner) > 10 else 0
        assert r.solidity == pytest.approx(len(inner) / (area or 10.0))
        first = sorted(k for k in somas if k % 2 == roi % 2)[:10]
        assert r.normalized == pytest.approx(len(inner) / np.mean([len(somas[k]) for k in first]))
        others = {(y, x) for p, k, y, x, _ in rows if p == r.plane and k != roi and k in stay}
        assert r.overlapping == sum((y, x) in others for _, _, y, x, _ in own)
        assert (r.cy, r.cx) in {(y, x) for _, _, y, x, _ in own}


def test_soma_of_regions_with_wide_gaps(spark):
    """Rings without pixels count as empty, whatever their number, and are never listed."""
    rng = np.random.default_rng(12)
    rows = []
    for roi in range(40):
        reach = [3, 12, 400, 100_000][roi % 4]
        spots = {(int(y), int(x)) for y, x in rng.normal(0, reach, (int(rng.integers(3, 60)), 2))}
        rows += [(roi, y, x, None if rng.random() < 0.1 else float(rng.integers(0, 9))) for y, x in sorted(spots)]
    table = spark.createDataFrame(rows, "roi long, y long, x long, weight double")
    out = shape.soma(table, "roi", "y", "x", "weight")
    got = {(r.roi, r.y, r.x): r.soma for r in out.collect()}
    centre = {r.roi: (r.cy, r.cx) for r in shape.centres(table, "roi", "y", "x").collect()}
    for roi in range(40):
        own = [q[1:] for q in rows if q[0] == roi]
        apart = [np.hypot(y - centre[roi][0], x - centre[roi][1]) for y, x, _ in own]
        last, sums = int(max(apart)), {}
        for d, (_, _, w) in zip(apart, own, strict=True):
            sums[int(d)] = sums.get(int(d), 0.0) + (w or 0.0)
        cut = max((w for r, w in sums.items() if 0 < r < last), default=0.0) / 3
        crop = np.inf
        if len(own) > 10 and cut > 0:
            first = min(r for r, w in sums.items() if 0 < r < last and w > cut)
            crop = next((r for r in range(first, last) if sums.get(r, 0.0) < cut), last)
        assert [got[roi, y, x] for y, x, _ in own] == [d < crop for d in apart]
    assert "sequence(" not in out._jdf.queryExecution().optimizedPlan().toString()
