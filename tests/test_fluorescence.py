"""Traces from frames as arrays, and the second channel's correction, against loops."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from imgtrace.operators import fluorescence

H, W = 9, 7


def _scene(spark, seed=1):
    rng = random.Random(seed)
    frames = [(p, t, [rng.gauss(10, 3) for _ in range(H * W)]) for p, n in ((0, 21), (4, 1), (5, 3)) for t in range(n)]
    built = []
    for p, rois in ((0, (3, 8, 2)), (4, (1,)), (9, (7,))):
        for roi in rois:
            own = rng.sample(range(H * W), 5)
            built += [(p, roi, x, 0.2) for x in own]
    around = [(0, roi, x) for roi in (8, 2) for x in rng.sample(range(H * W), 12)]
    tables = (spark.createDataFrame(frames, "plane long, t long, v array<double>"), spark.createDataFrame(built, "plane long, roi long, pixel long, share double"), spark.createDataFrame(around, "plane long, roi long, pixel long"))
    return frames, built, around, tables


def test_traces_are_sums_and_means_by_frame(spark):
    frames, built, around, tables = _scene(spark)
    own, near = defaultdict(list), defaultdict(list)
    for p, roi, x, share in built:
        own[p, roi].append((x, share))
    for p, roi, x in around:
        near[p, roi].append(x)
    want = {}
    for p, t, v in frames:
        for (q, roi), mask in own.items():
            if p == q:
                f = sum(v[x] * share for x, share in mask)
                n = float(np.mean([v[x] for x in near[p, roi]])) if near[p, roi] else 0.0
                want[p, roi, t] = (f, n, f - 0.7 * n)
    for span in (1, 4, 64):
        got = fluorescence.traces(tables[0].repartition(3), *tables[1:], "plane", "t", "v", H, W, 0.7, span=span).collect()
        assert len(got) == len(want) == 3 * 21 + 1
        for r in got:
            assert (r.fluorescence, r.neuropil, r.corrected) == pytest.approx(want[r.plane, r.roi, r.frame])
    found = fluorescence.traces(*tables, "plane", "t", "v", H, W, 0.7)
    values = np.array([x[2] for k, x in sorted(want.items()) if k[:2] == (0, 3)])
    row = fluorescence.activity(found).where("plane = 0 and roi = 3").first()
    m = values - values.mean()
    assert (row.frames, row["mean"], row.deviation, row.skewness) == pytest.approx((21, values.mean(), values.std(), (m**3).mean() / (m**2).mean() ** 1.5))
    assert fluorescence.activity(found).where("plane = 4").first().skewness == 0
    low = np.quantile(values, 0.08)
    assert {r.frame: r.delta for r in fluorescence.with_baseline(found, 0.08).where("plane = 0 and roi = 3").collect()} == pytest.approx(dict(enumerate(values - low)))


def test_frames_that_do_not_begin_at_0_are_an_error(spark):
    _, _, _, (frames, built, around) = _scene(spark)
    with pytest.raises(Exception, match="numbered 0"):
        fluorescence.traces(frames.where("t > 0"), built, around, "plane", "t", "v", H, W, 0.7).collect()


def _plain_corrected(f, s, blocks=3, fraction=0.25):
    h, w = f.shape
    sigma = round((h + w) / (2 * blocks) * fraction)

    def weight(at, block, length):
        bounds = [int(length * k / blocks) for k in range(blocks + 1)]
        total = kernel = 0.0
        for k in range(-4 * sigma, 4 * sigma + 1):
            bell = math.exp(-0.5 * (k / sigma) ** 2) if sigma else 1.0
            x = at + k
            while not 0 <= x < length:
                x = -1 - x if x < 0 else 2 * length - 1 - x
            total += bell * (bounds[block] <= x < bounds[block + 1])
            kernel += bell
        return total / kernel

    out = np.zeros_like(f)
    yb, xb = [int(h * k / blocks) for k in range(blocks + 1)], [int(w * k / blocks) for k in range(blocks + 1)]
    for y in range(h):
        for x in range(w):
            blend = 0.0
            for by in range(blocks):
                for bx in range(blocks):
                    a, b = (i[yb[by] : yb[by + 1], xb[bx] : xb[bx + 1]] for i in (f, s))
                    slope = (a * b).sum() / (a * a).sum() if (a * a).sum() > 0 else 0.0
                    blend += weight(y, by, h) * weight(x, bx, w) * slope
            out[y, x] = max(0.0, s[y, x] - f[y, x] * blend)
    return out


def test_bleedthrough_is_what_loops_give(spark):
    rng = np.random.default_rng(2)
    for h, w in ((H, W), (24, 31), (3, 3)):
        f, s = rng.random((2, h, w)), rng.random((2, h, w)) * 3
        f[1, : h // 2] = 0
        got = fluorescence.without_bleedthrough(f, s)
        assert got == pytest.approx(np.stack([_plain_corrected(a, b) for a, b in zip(f, s, strict=True)]))
    table = spark.createDataFrame([(3, f[0].ravel().tolist(), s[0].ravel().tolist())], "plane long, functional array<double>, structural array<double>")
    assert fluorescence.corrected_images(table, h, w).first().pixels == pytest.approx(got[0].ravel().tolist())


def test_colocalization_by_masks_and_surrounds(spark):
    _, built, around, tables = _scene(spark, 3)
    rng = random.Random(7)
    image = [rng.random() for _ in range(H * W)]
    images = spark.createDataFrame([(0, image), (4, [0.0] * H * W)], "plane long, pixels array<double>")
    got = {(r.plane, r.roi): r for r in fluorescence.colocalized(tables[1], tables[2], images, 0.5).collect()}
    assert set(got) == {(0, 3), (0, 8), (0, 2), (4, 1)}
    for (p, roi), r in got.items():
        inside = max(1e-3, sum(image[x] * s for q, k, x, s in built if (q, k) == (p, roi))) if p == 0 else 1e-3
        near = [image[x] for q, k, x in around if (q, k) == (p, roi)]
        outside = float(np.mean(near)) if near else 0.0
        assert (r.inside, r.outside, r.probability) == pytest.approx((inside, outside, inside / (inside + outside))) and r.colocalized == (r.probability > 0.5)
