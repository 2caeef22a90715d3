"""Components of frames from their products, against numpy's decomposition of the whole matrix."""

import numpy as np
import pytest

from imgtrace.operators import alignment, principal, registration


def _svd(stack, k):
    x = stack.reshape(len(stack), -1)
    x = x - x.mean(0)
    x = x - x.mean(1, keepdims=True)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    return u[:, :k] * np.sign(u[np.abs(u).argmax(0), np.arange(u.shape[1])])[:k], (s**2 / (s**2).sum())[:k]


def _table(spark, planes):
    return spark.createDataFrame([(p, t, f.ravel().tolist()) for p, stack in planes.items() for t, f in enumerate(stack)], "plane long, t long, v array<double>")


def test_scores_are_those_of_the_whole_matrix(spark):
    rng = np.random.default_rng(1)
    planes = {p: sum(rng.normal(size=(n, 1, 1)) * rng.normal(size=(1, 14, 11)) * (5 - k) for k in range(4)) + rng.normal(size=(n, 14, 11)) for p, n in ((0, 30), (3, 9))}
    for block in (16, 4096):
        got = {(r.plane, r.frame, r.component): (r.score, r.share) for r in principal.scores(_table(spark, planes), "plane", "t", "v", 3, block=block).collect()}
        assert len(got) == 3 * 39
        for p, stack in planes.items():
            u, share = _svd(stack, 3)
            for t in range(len(stack)):
                for k in range(3):
                    assert got[p, t, k] == pytest.approx((u[t, k], share[k]))


def test_frames_of_seventy_thousand_pixels(spark):
    rng = np.random.default_rng(2)
    stack = rng.normal(size=(6, 1, 1)) * rng.normal(size=(1, 250, 280)) * 3 + rng.normal(size=(6, 250, 280))
    u, share = _svd(stack, 2)
    for r in principal.scores(_table(spark, {0: stack}), "plane", "t", "v", 2).collect():
        assert (r.score, r.share) == pytest.approx((u[r.frame, r.component], share[r.component]))


def test_sampled_frames_and_few_frames(spark):
    rng = np.random.default_rng(3)
    table = _table(spark, {0: rng.normal(size=(50, 3, 3)), 1: rng.normal(size=(2, 3, 3))})
    rows = principal.scores(table, "plane", "t", "v", 4, most=10).collect()
    assert sorted({r.frame for r in rows if r.plane == 0}) == list(range(4, 50, 5)) or len({r.frame for r in rows if r.plane == 0}) == 10
    assert {r.component for r in rows if r.plane == 1} == {0, 1}


def test_metrics_see_the_motion_between_the_ends(spark):
    """Frames of plane 0 jump between two places three pixels apart, those of plane 1 only change in brightness."""
    rng = np.random.default_rng(4)
    image = np.fft.ifft2(np.fft.fft2(rng.normal(size=(32, 32))) * alignment.gaussian_response(1.0, 32, 32)).real * 100
    jumping = np.stack([np.roll(image, (3 * (t % 2), 0), (0, 1)) for t in range(24)]) + rng.normal(size=(24, 32, 32))
    steady = np.stack([image * (1 + 0.3 * (t % 2)) for t in range(24)]) + rng.normal(size=(24, 32, 32))
    steps = registration.Steps(32, 32, reach=5, sigma=1.0, slope=1.0, grid=alignment.Grid.over(32, 32, 16, 16), most=3.0, around=2)
    rows = principal.metrics(_table(spark, {0: jumping, 1: steady}), "plane", "t", "v", steps, 1, 8).collect()
    got = {r.plane: r for r in rows}
    assert len(rows) == 2 and got[0].rigid == 3 and got[1].rigid == 0 and got[1].blocks_most < 0.5 and got[0].share > 0.5
    found = principal.scores(_table(spark, {0: jumping}), "plane", "t", "v", 1)
    ends = principal.extremes(_table(spark, {0: jumping}), found, "plane", "t", "v", 5).first()
    order = [t for _, t in sorted((r.score, r.frame) for r in found.collect())]
    assert ends.low == pytest.approx(jumping[order[:5]].mean(0).ravel().tolist()) and ends.high == pytest.approx(jumping[order[-5:]].mean(0).ravel().tolist())
