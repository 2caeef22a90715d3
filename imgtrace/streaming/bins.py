"""Bins of a fixed count of frames on a stream: what Spark's time windows do not cover."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def counted_bins(frames: DataFrame, region: str, frame: str, value: str, size: int) -> DataFrame:
    """region, bin and mean of every `size` frames of a region as they arrive; state is the open bin's sum, count and number."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, n, number = state.get if state.exists else (0.0, 0, 0)
        out = []
        for x in pd.concat(list(parts)).sort_values(frame)[value].tolist():
            total, n = total + x, n + 1
            if n == size:
                out.append((key[0], number, total / size))
                total, n, number = 0.0, 0, number + 1
        state.update((total, n, number))
        yield pd.DataFrame(out, columns=[region, "bin", "f"])

    return frames.groupBy(region).applyInPandasWithState(
        run, f"{region} long, bin long, f double", "total double, n long, number long", "append", GroupStateTimeout.NoTimeout
    )
