"""Baselines and spikes on streams of traces: rows come out as soon as no later frame can change them.

Frames of a region arrive in order, 0, 1, 2, ..., any number in a batch; a row with a null value ends its region, gives out
what is left, and forgets the region. What comes out is what the batch operators give for the whole trace. State is kept
by Spark, so a stream goes on where it stopped.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from imgtrace.operators.registration import mirrored


def _in_order(parts: Iterator[pd.DataFrame], frame: str, value: str, due: int) -> tuple[list[float], bool]:
    """Values of the next frames, and whether the region ends."""
    rows = pd.concat(list(parts))
    ends = rows[value].isna()
    rows = rows[~ends].sort_values(frame)
    if rows[frame].tolist() != list(range(due, due + len(rows))):
        raise ValueError("frames of a region must arrive in order, each once")
    return rows[value].tolist(), bool(ends.any())


# ---- baseline


def baseline_of(held: np.ndarray, first: int, wanted: np.ndarray, n: int, half: int, weights: np.ndarray) -> np.ndarray:
    """The running maximum of the running minimum of the smoothed trace at the wanted frames; held[0] is frame `first`, n frames
    are known, and the trace is mirrored at its ends. Windows end with the trace."""
    reach = len(weights) // 2
    if not len(wanted):
        return np.zeros(0)
    near = np.arange(max(0, wanted[0] - 2 * half), min(n, wanted[-1] + 2 * half + 1))
    smooth = sum(w * held[mirrored(near + k, n) - first] for k, w in zip(range(-reach, reach + 1), weights, strict=True))
    over = lambda x, f, beyond: f(np.lib.stride_tricks.sliding_window_view(np.pad(x, half, constant_values=beyond), 2 * half + 1), axis=1)
    return over(over(smooth, np.min, np.inf), np.max, -np.inf)[wanted - near[0]]


def baselines(frames: DataFrame, region: str, frame: str, value: str, sigma: float, reach: int, half: int) -> DataFrame:
    """region, frame, value and baseline, 2 half + reach frames behind the newest; state is as many values again before these."""
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weights /= weights.sum()
    behind = 2 * half + reach

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, first, out = state.get if state.exists else ([], 0, 0)
        new, ended = _in_order(parts, frame, value, first + len(held))
        held, n = [*held, *new], first + len(held) + len(new)
        wanted = np.arange(out, n if ended else max(out, n - behind))
        found = baseline_of(np.array(held), first, wanted, n, half, weights)
        if len(wanted):
            yield pd.DataFrame({region: key[0], frame: wanted, value: np.array(held)[wanted - first], "baseline": found})
        if ended:
            state.remove()
        else:
            out = max(out, n - behind)
            keep = max(0, out - behind)
            state.update((held[keep - first :], keep, out))

    return frames.groupBy(region).applyInPandasWithState(
        run, f"{region} long, {frame} long, {value} double, baseline double", "held array<double>, first long, out long", "append", GroupStateTimeout.NoTimeout
    )


# ---- spikes


def _least_level(level: float, weight: float, length: int, decay: float, floor: float) -> float:
    """What a pool's level can fall to when it takes up frames of `floor` and more, however many."""
    numerator = weight * level + min(0.0, floor) * decay**length / (1 - decay)
    return numerator / (weight + decay ** (2 * length) / (1 - decay * decay)) if numerator > 0 else numerator / weight


def settled(pools: Sequence[Sequence[float]], decay: float, floor: float) -> int:
    """How many pools from the first on (level, weight, start, length) no later frame can change."""
    for k in range(len(pools) - 1, 0, -1):
        level, _, _, length = pools[k - 1]
        after = pools[k]
        if _least_level(after[0], after[1], int(after[3]), decay, floor) >= level * decay**length:
            return k
    return 0


def add_frame(pools: list[list[float]], at: int, value: float, decay: float) -> None:
    """Opens a pool for a frame, and merges the last two while the last starts below what the one before has decayed to."""
    pools.append([value, 1.0, at, 1])
    while len(pools) > 1 and pools[-1][0] < pools[-2][0] * decay ** pools[-2][3]:
        level, weight, _, length = pools.pop()
        before = pools[-1]
        shrunk = decay ** before[3]
        before[0] = (before[1] * before[0] + shrunk * weight * level) / (before[1] + shrunk * shrunk * weight)
        before[1] += shrunk * shrunk * weight
        before[3] += length


def spikes(frames: DataFrame, region: str, frame: str, value: str, time_constant: float, rate: float, floor: float = 0.0) -> DataFrame:
    """region, frame and spike, once the pools that a frame lies in and begins with can't change; values below `floor` are an error.

    A pool is settled once the next one would stay above what it decays to even if only `floor` came for ever. State is
    the pools from the last settled one on.
    """
    decay = math.exp(-1.0 / (time_constant * rate))

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        flat, due, out = state.get if state.exists else ([], 0, 0)
        pools = [list(p) for p in zip(*[iter(flat)] * 4)]
        new, ended = _in_order(parts, frame, value, due)
        for x in new:
            if x < floor:
                raise ValueError(f"a value below {floor}")
            add_frame(pools, due, x, decay)
            due += 1
        done = len(pools) if ended else settled(pools, decay, floor)
        upto = due if ended else (int(pools[done - 1][2] + pools[done - 1][3]) if done else out)
        found = np.zeros(upto - out)
        for (level, _, _, length), after in zip(pools[: max(done - 1, 0)], pools[1:done]):
            if after[2] >= out:
                found[int(after[2]) - out] = max(0.0, after[0] - level * decay**length)
        if upto > out:
            yield pd.DataFrame({region: key[0], frame: np.arange(out, upto), "spike": found})
        if ended:
            state.remove()
        else:
            state.update(([float(x) for p in pools[max(done - 1, 0) :] for x in p], due, upto))

    return frames.groupBy(region).applyInPandasWithState(run, f"{region} long, {frame} long, spike double", "pools array<double>, due long, out long", "append", GroupStateTimeout.NoTimeout)


# ---- tables as streams


def in_turns(spark: SparkSession, folder: str, parts: Sequence[DataFrame], build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream gives for tables that arrive one after the other; it stops and starts again between them."""
    base = f"{folder.rstrip('/')}/imgtrace-turns-{uuid.uuid4().hex}"
    for part in parts:
        part.write.mode("append").parquet(f"{base}/in")
        out = build(spark.readStream.schema(parts[0].schema).parquet(f"{base}/in"))
        stream = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append")
        stream.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")
