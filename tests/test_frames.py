"""Kernels of frames and shapes against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from imgtrace.operators import extraction, frames, images, movies, shape


@pytest.fixture(scope="module")
def stack():
    return np.random.default_rng(2).normal(size=(3, 7, 5))


def test_halving_of_odd_images(stack):
    for taper in (False, True):
        out = frames.halved(stack, taper)
        for y in range(4):
            for x in range(3):
                block = stack[:, 2 * y : 2 * y + 2, 2 * x : 2 * x + 2]
                assert out[:, y, x] == pytest.approx(block.sum((1, 2)) / (4 if taper else block[0].size))


@pytest.mark.parametrize("half", [1, 2, 9])
def test_box_mean_and_median(stack, half):
    mean, median = frames.box_mean(stack, half), frames.local_median(stack, half)
    for y in range(7):
        for x in range(5):
            near = stack[:, max(0, y - half) : y + half + 1, max(0, x - half) : x + half + 1].reshape(3, -1)
            assert mean[:, y, x] == pytest.approx(near.mean(1))
            zeros = np.zeros((3, (2 * half + 1) ** 2 - near.shape[1]))
            assert median[:, y, x] == pytest.approx(np.median(np.concatenate([near, zeros], 1), axis=1))


def test_shifts(stack):
    dy, dx = np.array([2, -3, 0]), np.array([-1, 4, 11])
    out = frames.translated(stack, dy, dx)
    assert all(np.array_equal(out[k], np.roll(stack[k], (-dy[k], -dx[k]), (0, 1))) for k in range(3))
    for offset in (2, -2, 0, 9):
        out = frames.odd_rows_shifted(stack, offset)
        assert np.array_equal(out[:, ::2], stack[:, ::2])
        for x in range(5):
            want = stack[:, 1::2, x - offset] if 0 <= x - offset < 5 else 0
            assert np.array_equal(out[:, 1::2, x], np.broadcast_to(want, (3, 3)))


def test_warp_by_whole_pixels_and_halves(stack):
    zero = np.zeros_like(stack)
    assert frames.warped(stack, zero, zero) == pytest.approx(stack)
    assert frames.warped(stack, zero + 1, zero)[:, :-1] == pytest.approx(stack[:, 1:])
    assert frames.warped(stack, zero, zero + 0.5)[:, :, :-1] == pytest.approx((stack[:, :, 1:] + stack[:, :, :-1]) / 2)
    # Before the first row, cutting toward zero goes on along the slope of the edge.
    assert frames.warped(stack, zero - 0.25, zero)[:, 0] == pytest.approx(stack[:, 0] - 0.25 * (stack[:, 1] - stack[:, 0]))


def test_taper_and_patch():
    mask = frames.taper_mask(9, 6, 1.5)
    assert mask == pytest.approx(mask[::-1, ::-1]) and mask.max() < 1 and mask[4, 2] > mask[0, 2] > mask[0, 0]
    assert frames.tapered(np.full((2, 9, 6), 3.0), mask, np.array([3.0, 3.0])) == pytest.approx(3.0)
    patch = frames.first_square(9, 6, 0, 5, 3)
    assert (patch > 0).sum() == 4 and (patch**2).sum() == pytest.approx(1)


def test_frames_of_a_wrong_size_are_refused(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0])], "frame long, v array<double>")
    with pytest.raises(Exception, match="2 \\* 2 pixels"):
        frames.per_frame(rows, "v", 2, 2, lambda x, _: x, ["frame"]).collect()
    assert frames.per_frame(rows.limit(0), "v", 2, 2, lambda x, _: x, ["frame"]).count() == 0


def test_hull_area_by_all_lines():
    rng = np.random.default_rng(5)
    assert shape.hull_area(np.array([[0, 0], [1, 1], [2, 2]])) == 0
    assert shape.hull_area(np.argwhere(np.ones((4, 6)))) == 15
    for _ in range(20):
        points = rng.integers(0, 12, (15, 2))
        # A pair of points is an edge if all others lie on one side; their triangles with a middle point fill the hull.
        middle, area = points.mean(0), 0.0
        distinct = np.unique(points, axis=0)
        for i, p in enumerate(distinct):
            for q in distinct[i + 1 :]:
                side = (q[0] - p[0]) * (distinct[:, 1] - p[1]) - (q[1] - p[1]) * (distinct[:, 0] - p[0])
                on = distinct[side == 0]
                along = on @ (q - p)
                if ((side >= 0).all() or (side <= 0).all()) and {along.min(), along.max()} == {p @ (q - p), q @ (q - p)}:
                    area += abs((p[0] - middle[0]) * (q[1] - middle[1]) - (p[1] - middle[1]) * (q[0] - middle[0])) / 2
        assert shape.hull_area(points) == pytest.approx(area)


def test_solidity_of_small_and_full_regions(spark):
    rows = [(1, y, x) for y in range(4) for x in range(6)] + [(2, 0, x) for x in range(4)] + [(3, 0, x) for x in range(20)]
    out = {r.roi: r.solidity for r in shape.solidity(spark.createDataFrame(rows, "roi long, y long, x long"), "roi", "y", "x").collect()}
    assert out == pytest.approx({1: 24 / 15, 2: 0.4, 3: 2.0})


def test_surrounds_grow_until_large_enough(spark):
    rng = np.random.default_rng(8)
    rows = {(p, r, int(y * 40 + x)) for p in range(2) for r in range(4) for y, x in rng.integers(0, 30, (12, 2)) // 2 + rng.integers(0, 16, 2)}
    out = extraction.surrounds(spark.createDataFrame(sorted(rows), "plane long, roi long, pixel long"), "plane", "roi", "pixel", 40, 40, 1, 120)
    got = {}
    for r in out.collect():
        got.setdefault((r.plane, r.roi), set()).add(r.pixel)
    for plane in range(2):
        held = {p for a, _, p in rows if a == plane}
        for roi in range(4):
            inner = {p for a, r, p in rows if (a, r) == (plane, roi)}
            inner |= {(p // 40 + dy) * 40 + p % 40 + dx for p in inner for dy, dx in ((0, 1), (0, -1), (1, 0), (-1, 0)) if 0 <= p // 40 + dy < 40 and 0 <= p % 40 + dx < 40}
            taken, box = len(inner - held), inner
            for _ in range(100):
                if len(box - held) - taken > 120:
                    break
                ys, xs = [p // 40 for p in box], [p % 40 for p in box]
                box = {y * 40 + x for y in range(max(0, min(ys) - 5), min(40, max(ys) + 6)) for x in range(max(0, min(xs) - 5), min(40, max(xs) + 6))}
            assert got[plane, roi] == box - held - inner


def test_smoothing_mirrors_short_traces(spark):
    rows = [(r, k, float((k * 7 + r) % 5)) for r, n in ((1, 2), (2, 1), (3, 9)) for k in range(n)]
    out = movies.weighted_in_time(spark.createDataFrame(rows, "roi long, frame long, v double"), "roi", "frame", "v", 1.5, 6)
    weights = np.exp(-0.5 * (np.arange(-6, 7) / 1.5) ** 2)
    weights /= weights.sum()
    for r in out.collect():
        own = np.array([v for a, _, v in rows if a == r.roi])
        assert r.smooth == pytest.approx(np.pad(own, 6, mode="symmetric")[r.frame : r.frame + 13] @ weights)


def test_windows_of_any_size_by_loops():
    rng = np.random.default_rng(8)
    x = rng.random((2, 7, 6))
    n, h, w = x.shape

    def near(k, y, c, before, after):
        return x[k, max(0, y - before) : max(0, y + after + 1), max(0, c - before) : max(0, c + after + 1)]

    for k in range(n):
        for y in range(h):
            for c in range(w):
                for window in (2, 4, 6):
                    box = near(k, y, c, window // 2 - 1, window // 2)
                    assert frames.smoothed(x, window)[k, y, c] == pytest.approx(box.sum() / window**2)
                    assert frames.high_passed(x, window)[k, y, c] == pytest.approx(x[k, y, c] - box.mean())
                for size in (1, 2, 3, 4):
                    box = near(k, y, c, size // 2, (size - 1) // 2)
                    assert frames.without_background(x, size)[k, y, c] == pytest.approx(x[k, y, c] - box.mean())
                    assert frames.square_response(x, size)[k, y, c] == pytest.approx(box.sum() / size)
    for window in (0, 3, -2):
        with pytest.raises(ValueError, match="even"):
            frames.smoothed(x, window)


def test_traces_less_their_slow_part(spark):
    rng = np.random.default_rng(9)
    table = {r: rng.random(n) for r, n in ((0, 40), (1, 3), (2, 1))}
    rows = spark.createDataFrame([(r, t, float(v)) for r, x in table.items() for t, v in enumerate(x)], "region long, frame long, f double")
    got = {(r.region, r.frame): r.passed for r in movies.high_pass(rows, "region", "frame", "f", 2).collect()}
    bell = np.exp(-0.5 * (np.arange(-8, 9) / 2) ** 2)
    for r, x in table.items():
        n = len(x)
        ring = np.concatenate([x, x[::-1]])
        for t in range(n):
            assert got[r, t] == pytest.approx(x[t] - sum(w * ring[(t + k) % (2 * n)] for k, w in zip(range(-8, 9), bell / bell.sum(), strict=True)))
    blocks = {(r.region, r.frame): r.passed for r in movies.high_pass(rows, "region", "frame", "f", 12).collect()}
    assert blocks[0, 5] == pytest.approx(table[0][5] - table[0][:12].mean()) and blocks[0, 39] == pytest.approx(table[0][39] - table[0][24:].mean())


@pytest.mark.parametrize("block", [3, 7, 100])
def test_similar_frames_of_all_blocks(spark, block):
    rng = np.random.default_rng(10)
    stack = {(p, p * 100 + t): rng.random(9) for p, n in ((0, 23), (1, 2), (2, 1)) for t in range(n)}
    rows = spark.createDataFrame([(p, t, v.tolist()) for (p, t), v in stack.items()], "plane long, frame long, v array<double>")
    got = sorted(map(tuple, images.similar_frames(rows, "frame", "plane", "v", 4, block=block).collect()))
    want = []
    for (p, t), v in stack.items():
        others = sorted((-round(np.corrcoef(v, u)[0, 1], 6), s) for (q, s), u in stack.items() if q == p and s != t)[:4]
        want += [(p, t, s, pytest.approx(-c, abs=2e-6), k + 1) for k, (c, s) in enumerate(others)]
    assert got == sorted(want, key=lambda x: (x[0], x[1], x[2])) or len(got) == len(want) and {x[:3] for x in got} == {x[:3] for x in want}


def test_similar_frames_of_equal_frames_and_few_pairs(spark, monkeypatch):
    """Ties go to the lower frame in every strip and block, and a long plane makes few rows."""
    monkeypatch.setattr(images, "AT_ONCE", 40)
    kinds = np.random.default_rng(11).random((5, 6))
    rows = spark.createDataFrame([(0, t, kinds[t % 5].tolist()) for t in range(60)], "plane long, frame long, v array<float>")
    for block in (8192, 13):
        got = {(r.frame, r.place): (r.other, r.correlation) for r in images.similar_frames(rows, "frame", "plane", "v", 4, block=block).collect()}
        alike = {t: [s for s in range(t % 5, 60, 5) if s != t][:4] for t in range(60)}
        assert got == {(t, k + 1): (s, 1.0) for t, near in alike.items() for k, s in enumerate(near)}
    many = spark.range(3000).select(F.lit(0).alias("plane"), F.col("id").alias("frame"), F.array(*(F.rand(k) for k in range(4))).alias("v"))
    assert sum(side.count() for side in images.dealt_pairs(many, "frame", "plane", "v", images.BLOCK_FRAMES)) == 3000
    assert sum(side.count() for side in images.dealt_pairs(many, "frame", "plane", "v", 1000)) == 9000
    assert images.similar_frames(many, "frame", "plane", "v", 2, block=1000).count() == 6000
