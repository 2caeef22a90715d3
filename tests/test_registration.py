"""The chain of registration steps against plain loops over a plane's frames, however frames are dealt into ranges."""

import numpy as np
import pytest

from imgtrace.operators import alignment, frames, registration

H, W = 24, 20


def _movie(seed, n):
    rng = np.random.default_rng(seed)
    noise = np.fft.ifft2(np.fft.fft2(rng.normal(size=(H, W))) * alignment.gaussian_response(1.0, H, W)).real * 100
    shifts = np.cumsum(rng.integers(-1, 2, (n, 2)), axis=0).clip(-3, 3)
    return noise, np.stack([np.roll(noise, s, (0, 1)) for s in shifts]) + rng.normal(size=(n, H, W)) * 4, shifts


def _plain(stack, second, image, steps):
    """Loops over frames, shifts and neighbours; blocks by the tested templates."""
    low, high = np.percentile(image, steps.clip)
    image = np.clip(image, low, high)
    mask = frames.taper_mask(H, W, steps.slope)
    held = np.conj(np.fft.fft2(image))
    held = held / (np.abs(held) + 1e-5) * alignment.gaussian_response(steps.sigma, H, W)
    r = steps.reach
    surfaces = []
    for f in stack:
        seen = np.fft.fft2(np.clip(f, low, high) * mask + image.mean() * (1 - mask))
        whole = np.fft.ifft2(seen / (np.abs(seen) + 1e-5) * held).real
        surfaces.append([[whole[y % H, x % W] for x in range(-r, r + 1)] for y in range(-r, r + 1)])
    surfaces = np.array(surfaces)
    half = int(4 * steps.in_time + 0.5)
    bell = [np.exp(-0.5 * (k / steps.in_time) ** 2) for k in range(-half, half + 1)] if half else [1.0]
    n, out = len(stack), []
    for t in range(n):
        total = np.zeros_like(surfaces[0])
        for k, w in zip(range(-half, half + 1), bell, strict=True):
            at = t + k
            while not 0 <= at < n:
                at = -1 - at if at < 0 else 2 * n - 1 - at
            total += surfaces[at] * w / sum(bell)
        y, x = np.unravel_index(total.argmax(), total.shape)
        dy, dx = y - r, x - r
        moved = [np.roll(c[t], (-dy, -dx), (0, 1)) for c in (stack, second)]
        by = bx = np.zeros((1, 0))
        if steps.grid:
            template = alignment.BlockTemplate.of(image, steps.grid, steps.sigma, steps.slope)
            by, bx, _ = template.offsets(np.clip(moved[0], low, high)[None], steps.most, steps.least_clear, steps.around)
            moved = [frames.warped(m[None], steps.grid.spread(by, H, W), steps.grid.spread(bx, H, W))[0] for m in moved]
        out.append((dy, dx, total[y, x], by[0], bx[0], *moved))
    return out


@pytest.mark.parametrize(("in_time", "blocks"), [(0.0, False), (1.0, True), (2.5, False)])
def test_chain_is_the_loop_over_frames(spark, in_time, blocks):
    steps = registration.Steps(H, W, reach=4, sigma=1.0, slope=2.0, in_time=in_time, grid=alignment.Grid.over(H, W, 14, 14) if blocks else None, most=2.0, around=2)
    planes = {p: _movie(p, n) for p, n in ((0, 33), (1, 5), (2, 1))}
    rows = [(p, t, f.ravel().tolist(), f[::-1].ravel().tolist()) for p, (_, stack, _) in planes.items() for t, f in enumerate(stack)]
    table = spark.createDataFrame(rows, "plane long, t long, v array<double>, other array<double>").repartition(3)
    references = spark.createDataFrame([(p, image.ravel().tolist()) for p, (image, _, _) in planes.items()], "plane long, reference array<double>")
    want = {(p, t): x for p, (image, stack, _) in planes.items() for t, x in enumerate(_plain(stack, stack[:, ::-1], image, steps))}
    for span in (2, 8, 64):
        got = registration.register(table, references, "plane", "t", "v", steps, second="other", span=span).collect()
        assert len(got) == len(want)
        for r in got:
            dy, dx, fit, by, bx, first, second = want[r.plane, r.frame]
            assert (r.dy, r.dx) == (dy, dx) and r.correlation == pytest.approx(fit)
            assert r.block_dy == pytest.approx(by.tolist()) and r.block_dx == pytest.approx(bx.tolist())
            assert np.reshape(r.pixels, (H, W)) == pytest.approx(first) and np.reshape(r.second_pixels, (H, W)) == pytest.approx(second)


def test_chain_finds_known_shifts_with_a_filter_and_scanned_lines(spark):
    image, stack, shifts = _movie(9, 20)
    crooked = frames.odd_rows_shifted(stack + 50 * np.linspace(0, 1, W), -1)
    steps = registration.Steps(H, W, reach=4, sigma=1.0, slope=1.0, odd_lines=1, clip=None, prepare=lambda x: frames.box_high_pass(x, 4))
    table = spark.createDataFrame([(0, t, f.ravel().tolist()) for t, f in enumerate(crooked)], "plane long, t long, v array<double>")
    references = spark.createDataFrame([(0, frames.box_high_pass(image[None], 4).ravel().tolist())], "plane long, reference array<double>")
    got = {r.frame: (r.dy, r.dx) for r in registration.rigid_offsets(table, references, "plane", "t", "v", steps, span=7).collect()}
    assert sum(got[t] == tuple(s) for t, s in enumerate(shifts.tolist())) >= 18


def test_gaps_between_frames_are_an_error_and_planes_without_a_reference_go(spark):
    steps = registration.Steps(2, 2, reach=1)
    table = spark.createDataFrame([(p, t, [1.0, 2.0, 3.0, 4.0]) for p, t in ((0, 0), (0, 2), (1, 0))], "plane long, t long, v array<double>")
    one = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0])], "plane long, reference array<double>")
    assert [(r.plane, r.dy, r.dx) for r in registration.rigid_offsets(table, one, "plane", "t", "v", steps).collect()] == [(1, 0, 0)]
    with pytest.raises(Exception, match="once each"):
        registration.rigid_offsets(table, one.selectExpr("0 AS plane", "reference"), "plane", "t", "v", steps).collect()


def test_image_sums_meet_in_a_tree(spark):
    rng = np.random.default_rng(1)
    rows = [(k % 3, rng.integers(0, 9, 6).astype(float).tolist()) for k in range(500)]
    table = spark.createDataFrame(rows, "plane long, v array<double>").repartition(150)
    for r in frames.summed_images(table, ["plane"], "v").collect():
        own = np.array([v for p, v in rows if p == r.plane])
        assert r.n == len(own) and r.pixels == own.sum(0).tolist()
    assert frames.summed_images(table.limit(0), ["plane"], "v").count() == 0
    assert {r.plane: r.pixels for r in frames.mean_images(table, ["plane"], "v").collect()}[0] == pytest.approx(np.mean([v for p, v in rows if p == 0], axis=0).tolist())
