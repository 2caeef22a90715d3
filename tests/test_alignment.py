"""Alignment, classification by grids, and tracking rules against plain loops."""

import numpy as np
import pytest

from imgtrace.operators import alignment, classifier, frames, masks, tracking


@pytest.fixture(scope="module")
def scene():
    """A smooth random image of 48 by 40 that wraps at its edges."""
    noise = np.random.default_rng(4).normal(size=(48, 40))
    return np.fft.ifft2(np.fft.fft2(noise) * alignment.gaussian_response(1.0, 48, 40)).real * 100


def test_phase_correlation_finds_shifts(scene):
    moved = np.stack([np.roll(scene, s, (0, 1)) for s in ((0, 0), (3, -2), (-4, 4))])
    dy, dx, top = alignment.peaks(alignment.surface(moved, alignment.template_spectrum(scene, 1.0), 5))
    assert (dy - 5).tolist() == [0, 3, -4] and (dx - 5).tolist() == [0, -2, 4]
    assert frames.translated(moved, dy - 5, dx - 5) == pytest.approx(np.stack([scene] * 3))
    assert top == pytest.approx(np.full(3, top[0]))


def test_grid_covers_the_image():
    grid = alignment.Grid.over(48, 40, 16, 64)
    assert grid.tops.tolist() == [0, 8, 16, 24, 32] and grid.lefts.tolist() == [0] and (grid.height, grid.width) == (16, 40)
    image = np.arange(48 * 40.0).reshape(48, 40)
    assert all(np.array_equal(block, image[t : t + 16]) for block, t in zip(grid.cut(image), grid.tops, strict=True))
    assert grid.neighbours().sum(1) == pytest.approx(1) and grid.neighbours()[0, 1] < grid.neighbours()[0, 0]
    field = grid.spread(np.arange(5.0)[None], 48, 40)[0]
    assert field[:, 0] == pytest.approx(np.clip((np.arange(48) - 8) / 8, 0, 4)) and np.ptp(field, axis=1) == pytest.approx(0)


def test_finer_values_pass_through_the_coarse_ones():
    weights = alignment.finer(3)
    assert weights[:, :: alignment.FINE] == pytest.approx(np.eye(7), abs=1e-8)


def test_clearness_by_loops():
    rng = np.random.default_rng(1)
    window = rng.random((2, 3, 9, 9))
    got = alignment.clearness(window, 2)
    for n in range(2):
        for b in range(3):
            w = window[n, b]
            py, px = max(((y, x) for y in range(2, 7) for x in range(2, 7)), key=lambda p: w[p])
            rest = max(w[y, x] for y in range(9) for x in range(9) if not (py - 2 <= y < py + 2 and px - 2 <= x < px + 2))
            assert got[n, b] == pytest.approx(w[py, px] / rest)


def test_block_offsets_to_a_fraction_of_a_pixel(spark, scene):
    fy, fx = np.fft.fftfreq(48)[:, None], np.fft.fftfreq(40)
    shifts = [(0.0, 0.0), (1.3, -0.8), (-2.0, 1.6)]
    moved = [np.fft.ifft2(np.fft.fft2(scene) * np.exp(-2j * np.pi * (fy * a + fx * b))).real for a, b in shifts]
    rows = spark.createDataFrame([(7, k, m.ravel().tolist()) for k, m in enumerate(moved)], "plane long, frame long, v array<double>")
    references = spark.createDataFrame([(7, scene.ravel().tolist())], "plane long, reference array<double>")
    grid = alignment.Grid.over(48, 40, 32, 32)
    args = (rows, references, "plane", "frame", "v", 48, 40, grid, 4.0, 1.0, 3.0)
    for r in alignment.block_offsets(*args).collect():
        assert len(r.dy) == len(r.dx) == len(r.peaks) == len(grid.tops) * len(grid.lefts)
        assert np.abs(np.array(r.dy) - shifts[r.frame][0]).max() <= 0.15 and np.abs(np.array(r.dx) - shifts[r.frame][1]).max() <= 0.15
    before, inner = [np.abs(m - scene)[8:-8, 8:-8].mean() for m in moved], {}
    for r in alignment.corrected(*args).collect():
        inner[r.frame] = np.abs(np.reshape(r.pixels, (48, 40)) - scene)[8:-8, 8:-8].mean()
    assert inner[1] < 0.4 * before[1] and inner[2] < 0.4 * before[2]
    assert alignment.block_offsets(rows.limit(0), references, *args[2:]).count() == 0
    with pytest.raises(ValueError, match="too small"):
        alignment.BlockTemplate.of(scene, alignment.Grid.over(48, 40, 6, 6), 1.0, 3.0).offsets(scene[None], 4.0, 1.2, 3)


def test_reference_of_moved_frames(spark, scene):
    rng = np.random.default_rng(9)
    moved = [np.roll(scene, rng.integers(-3, 4, 2), (0, 1)) + rng.normal(scale=0.3 * scene.std(), size=scene.shape) for _ in range(60)]
    rows = spark.createDataFrame([(1, k, m.ravel().tolist()) for k, m in enumerate(moved)], "plane long, frame long, v array<double>")
    out = np.reshape(alignment.reference_images(rows, "plane", "frame", "v", 48, 40, 6, 1.0, 3.0, most=40, partners=10).first().reference, (48, 40))
    best = max(np.corrcoef(np.roll(scene, (a, b), (0, 1)).ravel(), out.ravel())[0, 1] for a in range(-4, 5) for b in range(-4, 5))
    single = max(np.corrcoef(np.roll(scene, (a, b), (0, 1)).ravel(), moved[0].ravel())[0, 1] for a in range(-4, 5) for b in range(-4, 5))
    plain = max(np.corrcoef(np.roll(scene, (a, b), (0, 1)).ravel(), np.mean(moved, 0).ravel())[0, 1] for a in range(-4, 5) for b in range(-4, 5))
    assert best > single and best > plain and best > 0.98
    assert alignment.refined(scene[None], 1.0, 3.0, 4, 20, 8) is not None
    assert [r.frame for r in alignment.picked(rows, "plane", "frame", 4).orderBy("frame").collect()] == [14, 29, 44, 59]


@pytest.mark.parametrize("offset", [3, -2, 0])
def test_line_phase(spark, scene, offset):
    skewed = scene.copy()
    skewed[1::2] = np.roll(np.repeat(scene[::2], 1, 0), -offset, 1)
    rows = [(p, np.roll(skewed, 2 * k, 0).ravel().tolist()) for p in (3, 4) for k in range(5)]
    out = alignment.line_phases(spark.createDataFrame(rows, "plane long, v array<double>").repartition(3), "plane", "v", 48, 40)
    assert {r.plane: r.offset for r in out.collect()} == {3: offset, 4: offset}


def test_grid_classifier_by_newton(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=400), rng.integers(0, 9, 400).astype(float)
    label = (a + 0.3 * b + rng.normal(size=400) > 1).astype(int)
    rows = spark.createDataFrame([(k, float(x), float(y), int(z)) for k, (x, y, z) in enumerate(zip(a, b, label, strict=True))], "key long, a double, b double, label int")
    grid = classifier.probability_grid(rows, "key", "label", ["a", "b"], 100, 2.0)
    got = {r.feature: sorted((g.bin, g.node, g.share) for g in r.grid) for r in grid.collect()}
    weights = np.exp(-0.5 * (np.arange(-8, 9) / 2.0) ** 2)
    odds = []
    for name, values in (("a", a), ("b", b)):
        order = np.lexsort((np.arange(400), values))
        at = [k * 399 // 99 for k in range(100)]
        share = np.array([label[order][i:j].mean() for i, j in zip(at, at[1:], strict=False)])
        smooth = np.convolve(np.concatenate([share[7::-1], share, share[:-9:-1]]), weights / weights.sum(), "valid")
        assert [g[2] for g in got[name]][:99] == pytest.approx(smooth) and [g[1] for g in got[name]] == pytest.approx(values[order][at])
        place = np.clip([(values[order][at] < v).sum() - 1 for v in values], 0, 98)
        odds.append(np.log(smooth[place] + 1e-6) - np.log(1 - smooth[place] + 1e-6))
    x, w = np.column_stack([*odds, np.ones(400)]), np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(np.eye(3) / 100 + x.T @ (x * (p * (1 - p))[:, None]), w / 100 + x.T @ (p - label))
    strange = spark.createDataFrame([(1000, None, 2.0), (1001, 99.0, float("nan"))], "key long, a double, b double")
    out = classifier.classified(rows.select("key", "a", "b").union(strange), rows, "key", "label", ["a", "b"])
    found = {r.key: r for r in out.collect()}
    assert [found[k].probability for k in range(400)] == pytest.approx(1 / (1 + np.exp(-x @ w)), abs=1e-4)
    assert all(found[k].is_cell == (found[k].probability > 0.5) for k in found) and {1000, 1001} <= found.keys()
    with pytest.raises(ValueError, match="100 rows"):
        classifier.classified(rows.limit(50), rows.limit(50), "key", "label", ["a", "b"])


def test_bins_with_margins_and_accepted_clusters(spark):
    rng = np.random.default_rng(3)
    rois = [(k, int(y), int(x)) for k, (y, x) in enumerate(rng.integers(0, 90, (60, 2)))]
    out = {(r.roi, r.by, r.bx) for r in tracking.in_bins(spark.createDataFrame(rois, "roi long, y long, x long"), "y", "x", 30, 7, 90, 90).collect()}
    inside = lambda v, b: 30 * b - 7 < v < 30 * b + 37
    assert out == {(k, by, bx) for k, y, x in rois for by in range(3) for bx in range(3) if inside(y, by) and inside(x, bx)}
    members = [(0, 0, 1, 1, 1, 5, 5), (0, 0, 1, 2, 2, 6, 6), (0, 1, 1, 2, 2, 6, 31), (0, 1, 1, 3, 1, 6, 35), (1, 1, 4, 4, 1, 40, 40), (1, 1, 4, 5, 1, 41, 40), (2, 2, 5, 6, 1, 10, 80), (2, 2, 5, 7, 2, 10, 80)]
    table = spark.createDataFrame(members, "by long, bx long, cluster long, roi long, recording long, y long, x long")
    got = {(r.by, r.bx, r.cluster, r.roi) for r in tracking.accepted(table, 30, 2).collect()}
    # Region 2 goes to the first bin that claims it, one recording is too few, and a centre outside its bin doesn't count.
    assert got == {(0, 0, 1, 1), (0, 0, 1, 2), (0, 1, 1, 3)}


def test_masks_follow_a_field(spark):
    rng = np.random.default_rng(7)
    weight, dy, dx = (rng.random((6, 9)) > 0.5) * rng.random((6, 9)), rng.uniform(-2, 2, (6, 9)), rng.uniform(-2, 2, (6, 9))
    regions = spark.createDataFrame([(1, 4, k, float(w)) for k, w in enumerate(weight.ravel()) if w], "recording long, roi long, pixel long, weight double")
    field = spark.createDataFrame([(1, k, float(a), float(b)) for k, (a, b) in enumerate(zip(dy.ravel(), dx.ravel(), strict=True))], "recording long, pixel long, dy double, dx double")
    got = {r.pixel: r.weight for r in masks.moved_by_field(regions, field, "recording", 6, 9).collect()}
    want = {}
    for y in range(6):
        for x in range(9):
            sy, sx = int(np.floor(y + dy[y, x] + 0.5)), int(np.floor(x + dx[y, x] + 0.5))
            if 0 <= sy < 6 and 0 <= sx < 9 and weight[sy, sx]:
                want[y * 9 + x] = weight[sy, sx]
    assert got == want
