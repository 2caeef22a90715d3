"""Spike inference: pools of frames with exponential decay, one trace in a task at a time."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def infer_spikes(trace: np.ndarray, decay: float) -> np.ndarray:
    """Non-negative spikes of a trace whose level decays by a factor each frame.

    Each pool has a level at its start, a weight and a length. A frame opens a pool; while the last pool starts lower than
    the one before would have decayed to, the two merge by the weighted least-squares level. Spikes are what each pool's
    start adds to the decayed level before; the first frame has none.
    """
    pools: list[list[float]] = []  # level, weight, first frame, length
    for t, value in enumerate(trace.tolist()):
        pools.append([value, 1.0, t, 1])
        while len(pools) > 1 and pools[-1][0] < pools[-2][0] * decay ** pools[-2][3]:
            level, weight, _, length = pools.pop()
            before = pools[-1]
            shrunk = decay ** before[3]
            before[0] = (before[1] * before[0] + shrunk * weight * level) / (before[1] + shrunk * shrunk * weight)
            before[1] += shrunk * shrunk * weight
            before[3] += length
    out = np.zeros(len(trace))
    for (level, _, _, length), after in zip(pools, pools[1:]):
        out[int(after[2])] = max(0.0, after[0] - level * decay**length)
    return out


def spikes(traces: DataFrame, region: str, frame: str, value: str, time_constant: float, rate: float) -> DataFrame:
    """region, frame and spike of traces sampled `rate` times a second; a trace is a task's unit of work."""
    decay = math.exp(-1.0 / (time_constant * rate))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(frame)
        return pd.DataFrame({region: rows[region], frame: rows[frame], "spike": infer_spikes(rows[value].to_numpy(float), decay)})

    return traces.select(region, frame, value).groupBy(region).applyInPandas(run, f"{region} long, {frame} long, spike double")
