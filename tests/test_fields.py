"""Fields and their inverses, and masks that go into the common view and back."""

import numpy as np
import pytest

from imgtrace.operators import fields

H, W = 60, 50


def _field(k):
    y, x = np.indices((H, W)) / 10
    return 2.5 * np.sin(y / 1.5 + k) * np.cos(x / 2), 2.0 * np.cos(y / 2) * np.sin(x / 1.5 - k)


def _table(spark, ks):
    return spark.createDataFrame([(k, *(a.ravel().tolist() for a in _field(k))) for k in ks], "recording long, dy array<double>, dx array<double>")


def test_inverse_leads_back():
    for k in range(3):
        f = tuple(a[None] for a in _field(k))
        g = fields.inverse(*f)
        for there in (fields.chained(f, g), fields.chained(g, f)):
            inner = np.stack(there)[:, 0, 6:-6, 6:-6]
            assert np.abs(inner).max() < 0.05
    constant = np.full((1, H, W), 3.0), np.full((1, H, W), -2.0)
    assert fields.inverse(*constant)[0] == pytest.approx(-3.0) and fields.chained(constant, constant)[1] == pytest.approx(-4.0)


def test_fields_of_many_recordings(spark):
    table = _table(spark, range(3))
    back = {r.recording: r for r in fields.inverted(table, H, W).collect()}
    both = {r.recording: r for r in fields.composed(table, fields.inverted(table, H, W), H, W).collect()}
    for k in range(3):
        g = fields.inverse(*(a[None] for a in _field(k)))
        assert back[k].dy == pytest.approx(g[0].ravel().tolist()) and back[k].dx == pytest.approx(g[1].ravel().tolist())
        assert both[k].dy == pytest.approx(fields.chained(tuple(a[None] for a in _field(k)), g)[0].ravel().tolist())


def test_images_are_sampled_along_a_field(spark):
    image = np.add.outer(np.arange(H) * 2.0, np.arange(W) * 3.0)
    rows = spark.createDataFrame([(1, image.ravel().tolist()), (9, image.ravel().tolist())], "recording long, pixels array<double>")
    (out,) = fields.warped_images(rows, _table(spark, [1]), H, W).collect()
    dy, dx = _field(1)
    want = 2 * np.clip(np.arange(H)[:, None] + dy, 0, H - 1) + 3 * np.clip(np.arange(W) + dx, 0, W - 1)
    assert np.reshape(out.pixels, (H, W)) == pytest.approx(want)


def test_masks_come_back_within_a_pixel(spark):
    masks = [(k, roi, (y + a) * W + x + b, 1.0 + roi) for k in range(3) for roi, (y, x) in enumerate(((20, 15), (35, 30), (25, 40))) for a in range(-3, 4) for b in range(-3, 4)]
    regions = spark.createDataFrame(masks, "recording long, roi long, pixel long, weight double")
    table = _table(spark, range(3))
    common = fields.into_common(regions, table, H, W)
    there = {(r.recording, r.roi): (r.y, r.x) for r in fields.summary(common, "roi", W).collect()}
    start = {(r.recording, r.roi): (r.y, r.x) for r in fields.summary(regions, "roi", W).collect()}
    assert any(there[k] != start[k] for k in start)
    one = common.where("recording = 0").selectExpr("roi AS cluster", "pixel", "weight")
    seen = fields.into_recordings(one, table, H, W)
    assert {(r.recording, r.cluster) for r in seen.select("recording", "cluster").distinct().collect()} == {(k, c) for k in range(3) for c in range(3)}
    home = {r.cluster: r for r in fields.summary(seen.where("recording = 0"), "cluster", W).collect()}
    for roi in range(3):
        y, x = start[0, roi]
        assert abs(home[roi].y - y) <= 1 and abs(home[roi].x - x) <= 1 and 35 <= home[roi].pixels <= 65
    own = {(r.cluster, r.pixel) for r in seen.where("recording = 0").collect()}
    near = {(roi, p + s) for k, roi, p, _ in masks if k == 0 for s in (0, 1, -1, W, -W, W + 1, W - 1, -W + 1, -W - 1)}
    assert own <= near and all(r.weight == 1.0 + r.cluster for r in seen.collect())
