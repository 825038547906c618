"""Structured Streaming form of the ordered fold of averages and signals, with state per series."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.session import ship

_OUT = "symbol string, time timestamp, close double, fast double, slow double, direction double, n bigint"
_STATE = "last bigint, n bigint, fast double, slow double"


def live_crossover(bars: DataFrame, fast: int, slow: int) -> DataFrame:
    """Direction of a crossover of exponential averages for every bar of a stream (columns symbol, time, close).

    The state of a series is its last time and both averages, so it doesn't grow. Bars of a batch are taken in order of time; a bar that isn't later
    than the last one of its series is dropped, as the averages can't be taken back, and so are bars without time or close. The direction is 0 for the first `slow` bars.
    """
    ship(bars.sparkSession)
    a, b = 2.0 / (fast + 1), 2.0 / (slow + 1)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n, f, s = state.get if state.exists else (None, 0, 0.0, 0.0)
        rows = pd.concat(list(parts)).sort_values("time", kind="stable")
        out = []
        for t, c in zip(rows["time"], rows["close"]):
            if pd.isna(t) or pd.isna(c) or (last is not None and t.value <= last):
                continue
            f, s = (c, c) if n == 0 else (f + a * (c - f), s + b * (c - s))
            n, last = n + 1, t.value
            ready = n > slow
            out.append((key[0], t, c, f if n >= fast else None, s if n >= slow else None, float((f > s) - (f < s)) if ready else 0.0, n))
        if last is not None:
            state.update((last, n, f, s))
        yield pd.DataFrame(out, columns=["symbol", "time", "close", "fast", "slow", "direction", "n"])

    return bars.select("symbol", "time", "close").groupBy("symbol").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)
