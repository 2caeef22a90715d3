"""Numeric kernels against plain versions."""

import struct

import numpy as np
import pytest

from imgtrace.functions import temporal
from imgtrace.operators import deconvolution, masks, rois, tracking
from imgtrace.sources import tiff
from imgtrace.streaming import windows


def test_spikes_of_clean_decay():
    decay, trace = 0.9, np.zeros(100)
    for start, size in ((50, 10.0), (70, 4.0)):
        trace[start:] += size * decay ** np.arange(100 - start)
    found = deconvolution.infer_spikes(trace, decay)
    assert np.flatnonzero(found > 1e-6).tolist() == [50, 70]
    assert found[[50, 70]] == pytest.approx([10, 4])


def test_spikes_are_least_squares():
    """Scaling by the decay turns the fit into isotonic regression, checked by its min-max formula."""
    rng, decay, n = np.random.default_rng(3), 0.8, 12
    trace = rng.normal(0, 1, n) + 3
    scale = decay ** -np.arange(n)
    mean = lambda a, b: (trace[a:b] * scale[a:b] / scale[a:b] ** 2).sum() / (1 / scale[a:b] ** 2).sum()
    level = np.array([max(min(mean(a, b) for b in range(t + 1, n + 1)) for a in range(t + 1)) for t in range(n)]) / scale
    want = np.maximum(0, np.diff(level, prepend=level[0] / decay) - 0)
    want = np.array([0.0, *(max(0.0, level[t] - decay * level[t - 1]) for t in range(1, n))])
    assert deconvolution.infer_spikes(trace, decay) == pytest.approx(want, abs=1e-9)


def test_complete_linkage_cuts_at_the_greatest_distance():
    d = np.array([[0, 1, 4, 9], [1, 0, 2, 9], [4, 2, 0, 9], [9, 9, 9, 0]], float)
    assert tracking.complete_linkage(d, 3).tolist() == [0, 0, 1, 2]
    assert tracking.complete_linkage(d, 4).tolist() == [0, 0, 0, 1]


def test_greedy_overlap_goes_from_the_last(spark):
    rows = [(0, r, p) for r, ps in ((1, [1, 2, 3]), (2, [3, 4, 5]), (3, [4, 5, 3])) for p in ps]
    out = tracking.without_overlapping(spark.createDataFrame(rows, "plane long, roi long, pixel long"), "plane", "roi", "pixel", 0.5)
    assert [r.roi for r in out.collect()] == [1, 2]


def test_mutual_match_ties_go_to_the_lower_region(spark):
    make = lambda rows: spark.createDataFrame(rows, "roi long, pixel long")
    out = masks.mutual_matches(make([(1, 1), (1, 2), (2, 9)]), make([(5, 1), (5, 2), (4, 1), (4, 2)]), "roi", "pixel", 0.5)
    assert sorted(map(tuple, out.collect())) == [(1, 4, 1.0), (2, -1, 0.0)]


def test_natural_key_orders_numbers(spark):
    names = spark.createDataFrame([("f10.tif",), ("f9.tif",), ("f1.tif",)], "name string")
    assert [r.name for r in names.orderBy(rois.natural_key(names.name)).collect()] == ["f1.tif", "f9.tif", "f10.tif"]


def test_incomplete_cycle_is_left_out(spark):
    pages = spark.createDataFrame([(i,) for i in range(14)], "page long")
    out = temporal.demultiplexed(pages, "page", 2, 2)
    assert out.count() == 12 and {(r.plane, r.channel) for r in out.collect()} == {(0, 0), (0, 1), (1, 0), (1, 1)}


def _tiff(pages, order="<"):
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in pages:
        data = page.astype(order + "u2").tobytes()
        at = len(out)
        out += data
        struct.pack_into(order + "I", out, link, len(out))
        tags = ((256, 4, page.shape[1]), (257, 4, page.shape[0]), (258, 3, 16), (259, 3, 1), (273, 4, at), (279, 4, len(data)))
        out += struct.pack(order + "H", len(tags))
        for tag, kind, value in tags:
            out += struct.pack(order + "HHI", tag, kind, 1) + (struct.pack(order + "HH", value, 0) if kind == 3 else struct.pack(order + "I", value))
        link = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff_pages_are_read_and_halved(spark, tmp_path, order):
    pages = [np.arange(6).reshape(2, 3) * 11 + k for k in range(3)]
    (tmp_path / "a.tif").write_bytes(_tiff(pages, order))
    spark.dataSource.register(tiff.TiffPages)
    rows = sorted(spark.read.format("tiff_pages").load(str(tmp_path)).collect(), key=lambda r: r.page)
    assert [(r.height, r.width) for r in rows] == [(2, 3)] * 3
    assert [r.pixels for r in rows] == [(p // 2).ravel().tolist() for p in pages]


def test_stream_and_table_agree(spark):
    path = "/root/testdata/sf0.001/events.parque[t]"
    streamed = windows.tumbling(spark, path, "ts", "6 hours", "event_type", "value")
    table = windows.counted(spark.read.parquet(path), "ts", "6 hours", "event_type", "value")
    tidy = lambda df: sorted((str(r.start), r.event_type, r.n, round(r.total, 3)) for r in df.collect())
    assert tidy(streamed) == tidy(table)


def test_streamed_sessions_are_those_of_the_table(spark):
    path = "/root/testdata/sf0.001/events.parque[t]"
    tidy = lambda df: sorted((r.user_id, str(r.start), r.n, round(r.total, 3)) for r in df.collect())
    assert tidy(windows.streamed_sessions(spark, path, "user_id", "ts", "value", "6 hours")) == tidy(windows.sessions(spark.read.parquet(path), "user_id", "ts", "value", "6 hours"))


def test_a_stream_of_no_events_has_no_windows(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(0).write.parquet(str(tmp_path / "e"))
    assert windows.tumbling(spark, str(tmp_path / "e"), "ts", "6 hours", "event_type", "value").count() == 0
