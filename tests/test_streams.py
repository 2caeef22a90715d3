"""Streams of traces give what the batch operators give, over batches, restarts, and regions that end at different times."""

import numpy as np
import pandas as pd
import pytest

from imgtrace.functions import temporal
from imgtrace.operators import deconvolution, movies
from imgtrace.plans import chains
from imgtrace.streaming import traces


def _traces(seed, lengths):
    rng = np.random.default_rng(seed)
    return {r: np.abs(rng.normal(size=n)).cumsum() % 3 + (rng.random(n) < 0.1) * 4 for r, n in enumerate(lengths)}


def _parts(spark, table, cuts):
    """Rows by frame, cut into tables that follow each other; a region's end comes with its last frame."""
    ends = [0, *cuts, 10**6]
    out = []
    for low, high in zip(ends, ends[1:], strict=False):
        rows = [(r, t, float(x)) for r, v in table.items() for t, x in enumerate(v) if low <= t < high]
        rows += [(r, None, None) for r, v in table.items() if low < len(v) <= high]
        out.append(spark.createDataFrame(rows, "region long, frame long, value double").repartition(2))
    return out


def _table(spark, table):
    return spark.createDataFrame([(r, t, float(x)) for r, v in table.items() for t, x in enumerate(v)], "region long, frame long, value double")


@pytest.mark.parametrize("lengths", [(60, 7, 31, 1, 45)])
def test_streamed_baselines_are_the_batch_ones(spark, tmp_path, lengths):
    table = _traces(1, lengths)
    smooth = movies.weighted_in_time(_table(spark, table), "region", "frame", "value", 1.0, 4)
    want = {(r.region, r.frame): r.baseline for r in temporal.maximin_baseline(smooth, "region", "frame", "smooth", 3).collect()}
    got = traces.in_turns(spark, str(tmp_path), _parts(spark, table, (9, 30, 33)), lambda s: traces.baselines(s, "region", "frame", "value", 1.0, 4, 3)).collect()
    assert len(got) == len(want) == sum(lengths)
    for r in got:
        assert r.baseline == pytest.approx(want[r.region, r.frame]) and r.value == table[r.region][r.frame]


def test_streamed_spikes_are_the_batch_ones(spark, tmp_path):
    table = _traces(2, (80, 3, 41, 1, 66))
    want = {(r.region, r.frame): r.spike for r in deconvolution.spikes(_table(spark, table), "region", "frame", "value", 0.7, 10.0).collect()}
    got = traces.in_turns(spark, str(tmp_path), _parts(spark, table, (10, 40, 41)), lambda s: traces.spikes(s, "region", "frame", "value", 0.7, 10.0)).collect()
    assert len(got) == len(want) == 191
    for r in got:
        assert r.spike == pytest.approx(want[r.region, r.frame])


def test_settled_pools_never_change():
    """Whatever comes later, down to the floor, leaves settled pools as they are; and most pools settle soon."""
    rng = np.random.default_rng(3)
    decay = 0.8
    for floor in (0.0, -0.5):
        settled = []
        for _ in range(60):
            pools, kept = [], []
            for t in range(120):
                value = floor if rng.random() < 0.3 or (t > 60 and rng.random() < 0.9) else floor + rng.exponential() * rng.choice([0.2, 3])
                traces.add_frame(pools, t, value, decay)
                assert [tuple(p) for p in pools[: len(kept)]] == kept
                kept = [tuple(p) for p in pools[: traces.settled(pools, decay, floor)]]
            settled.append(len(kept))
        assert min(settled) > 0 and np.mean(settled) > 3


def test_what_a_stream_refuses(spark):
    one = lambda *rows: iter([pd.DataFrame(rows, columns=["frame", "value"])])
    assert traces._in_order(one((4, 1.0), (3, 2.0), (None, None)), "frame", "value", 3) == ([2.0, 1.0], True)
    for rows in (((4, 1.0),), ((3, 1.0), (3, 1.0)), ((3, 1.0), (5, 1.0))):
        with pytest.raises(ValueError, match="in order"):
            traces._in_order(one(*rows), "frame", "value", 3)


def test_baseline_windows_end_with_the_trace_and_parts_read_one_table(spark, monkeypatch):
    rng = np.random.default_rng(23)
    weights = np.exp(-0.5 * np.arange(-2, 3) ** 2)
    weights /= weights.sum()
    for n in (1, 2, 5, 30):
        x = rng.normal(size=n)
        ring = np.concatenate([x, x[::-1]])
        smooth = [sum(w * ring[(t + k) % (2 * n)] for k, w in zip(range(-2, 3), weights, strict=True)) for t in range(n)]
        low = [min(smooth[max(0, t - 4) : t + 5]) for t in range(n)]
        assert traces.baseline_of(x, 0, np.arange(n), n, 4, weights) == pytest.approx([max(low[max(0, t - 4) : t + 5]) for t in range(n)])
    plans = []
    monkeypatch.setattr(chains.streams, "in_turns", lambda spark, folder, parts, build: plans.extend(p._jdf.queryExecution().optimizedPlan().toString() for p in parts) or spark.createDataFrame([], "value double, baseline double"))
    chains.stream_baseline(spark, "/root/testdata/sf0.001")
    chains.stream_spikes(spark, "/root/testdata/sf0.001")
    assert len(plans) == 6 and not any("Window" in p for p in plans)
