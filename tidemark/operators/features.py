"""Composable features of bars as window columns.

A feature is a base indicator followed by transforms. All window columns share one partitioning and ordering, so a whole pipeline costs one shuffle
and one sort; every stage is a projection of its own because a transform of a window is a window over a window.
Recurrences (EMA, ADX) run together in one ordered pass per series.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Protocol, runtime_checkable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.blocks import halo, with_blocks
from tidemark.schema import require_ohlcv
from tidemark.session import ship

EXACT = "decimal(38,0)"
BITS = 96  # of a sum's whole part, counted from the greatest value of the series
FADED = 40.0  # a weight of exp(-40) is below the last digit of a double


@dataclass(frozen=True)
class Frame:
    """How the rows of a series are partitioned and ordered."""

    keys: tuple[str, ...]
    time: str = "time"

    @property
    def ordered(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(self.time)

    def last(self, n: int) -> WindowSpec:
        return self.ordered.rowsBetween(-(n - 1), 0)

    @property
    def whole(self) -> WindowSpec:
        return Window.partitionBy(*self.keys)

    @property
    def so_far(self) -> WindowSpec:
        return self.ordered.rowsBetween(Window.unboundedPreceding, 0)


@runtime_checkable
class Indicator(Protocol):
    name: str
    lookback: int

    def columns(self, frame: Frame) -> dict[str, Column]: ...


@runtime_checkable
class Transform(Protocol):
    name: str
    lookback: int

    def apply(self, col: Column, frame: Frame) -> Column: ...


@runtime_checkable
class Recurrence(Protocol):
    """An indicator that needs its own previous value: `fold` gets the series' rows in order and gives its columns."""

    name: str
    lookback: int
    sources: tuple[str, ...]
    memory: int  # rows after which earlier ones no longer show in a double

    def fold(self, rows: pd.DataFrame) -> dict[str, np.ndarray]: ...


@dataclass(frozen=True)
class SMA:
    """Simple moving average: null unless there are `period` values and none is missing or infinite.

    Taken as the difference of two exact running sums, so it costs the same for any period and constant stretches give exactly their value. The sums are of whole
    numbers: every value is scaled by the power of two that brings the greatest of its series (or block) to 96 bits, so values of any magnitude keep all their digits unless they are 2^43 times
    smaller than the greatest one. A window over a window needs two projections, which `stages` gives.
    """

    period: int
    source: str = "close"

    @property
    def name(self) -> str:
        return f"sma_{self.period}_{self.source}"

    @property
    def lookback(self) -> int:
        return self.period

    @property
    def sources(self) -> tuple[str, ...]:
        return (self.source,)

    def stages(self, frame: Frame) -> list[dict[str, Column]]:
        x = F.col(self.source).cast("double")
        x = F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)
        s, c, up = f"_sum_{self.source}", f"_cnt_{self.source}", f"_up_{self.source}"
        top = F.max(F.abs(x)).over(frame.whole)
        bits = F.least(F.lit(float(BITS)) - F.floor(F.log2(F.when(top > 0, top).otherwise(1.0))), F.lit(1170.0))
        # in two steps, as one power of two may be beyond a double
        half = F.floor(F.col(up) / 2).cast("double")
        power = lambda e: F.pow(F.lit(2.0), e)
        exact = (x * power(half) * power(F.col(up) - half)).try_cast(EXACT)
        zero = F.lit(0).cast(EXACT)
        total = F.col(s) - F.coalesce(F.lag(s, self.period).over(frame.ordered), zero)
        full = F.col(c) - F.lag(c, self.period, 0).over(frame.ordered) == self.period
        mean = (total / F.lit(self.period).cast("decimal(10,0)")).cast("double") * power(half - F.col(up)) * power(-half)
        return [
            {up: bits},
            {s: F.coalesce(F.sum(exact).over(frame.so_far), zero), c: F.count(exact).over(frame.so_far)},
            {self.name: F.when(full, mean)},
        ]


@dataclass(frozen=True)
class EMA:
    """Exponential moving average with alpha 2/(period+1), started at the first value; null for the first period-1 rows.

    A gap in the source lets earlier weights decay on, as weights are by position.
    """

    period: int
    source: str = "close"

    @property
    def name(self) -> str:
        return f"ema_{self.period}_{self.source}"

    @property
    def lookback(self) -> int:
        return self.period

    @property
    def sources(self) -> tuple[str, ...]:
        return (self.source,)

    @property
    def memory(self) -> int:
        return self.period + math.ceil(FADED / -math.log1p(-min(0.999, 2.0 / (self.period + 1))))

    def fold(self, rows: pd.DataFrame) -> dict[str, np.ndarray]:
        x = rows[self.source].astype(float)
        return {self.name: x.ewm(span=self.period, min_periods=self.period, adjust=False).mean().to_numpy()}


def true_range(frame: Frame) -> Column:
    """Greatest of high-low and the distances of both from the close before; null for a series' first row."""
    prev = F.lag("close").over(frame.ordered)
    return F.when(prev.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)))


def directional_moves(frame: Frame) -> tuple[Column, Column]:
    """Upward and downward movement: the larger of the two rises counts, if above zero; a tie counts for neither."""
    up = F.col("high") - F.lag("high").over(frame.ordered)
    down = F.lag("low").over(frame.ordered) - F.col("low")
    pick = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.when((a > b) & (a > 0), a).otherwise(0.0))
    return pick(up, down), pick(down, up)


@dataclass(frozen=True)
class ADX:
    """Average directional index with Wilder's smoothing.

    Smoothed sums start at row `period` with the sum of rows 1..period and go on as s - s/period + x. The index starts at row 2*period with the mean
    of DX over period+1..2*period and goes on as (before*(period-1) + dx)/period. A smoothed range of zero leaves DX, and from there on the index, null.
    """

    period: int = 14
    splits: bool = field(default=False, init=False, repr=False)

    @property
    def name(self) -> str:
        return f"adx_{self.period}"

    @property
    def lookback(self) -> int:
        return 2 * self.period

    @property
    def sources(self) -> tuple[str, ...]:
        return ("high", "low", "close")

    @property
    def memory(self) -> int:
        return 2 * self.period + 2 * math.ceil(FADED / -math.log1p(-min(0.999, 1.0 / self.period)))

    def fold(self, rows: pd.DataFrame) -> dict[str, np.ndarray]:
        p, n = self.period, len(rows)
        out = np.full(n, np.nan)
        if n <= p:
            return {self.name: out}
        h, lo, c = (rows[x].to_numpy(float) for x in self.sources)
        with np.errstate(invalid="ignore", divide="ignore"):
            tr = np.fmax(np.fmax(h[1:] - lo[1:], np.abs(h[1:] - c[:-1])), np.abs(lo[1:] - c[:-1]))
            up, down = h[1:] - h[:-1], lo[:-1] - lo[1:]
            plus = np.where((up > down) & (up > 0), up, 0.0)
            minus = np.where((down > up) & (down > 0), down, 0.0)
            str_, sp, sm = (_wilder_sum(x, p) for x in (tr, plus, minus))
            dip, dim = 100.0 * sp / str_, 100.0 * sm / str_
            both = dip + dim
            dx = np.where(both == 0, 0.0, 100.0 * np.abs(dip - dim) / both)
            dx[(str_ == 0) | np.isnan(str_)] = np.nan
        # dx[k] belongs to row p + k
        if n > 2 * p:
            out[2 * p:] = _smooth(dx[1:p + 1].mean(), dx[p + 1:], p)
        return {self.name: out}


def _smooth(first: float, rest: np.ndarray, p: int) -> np.ndarray:
    """The recurrence y = y + (x - y)/p from `first` on; a missing value leaves all later ones missing."""
    x = np.concatenate(([first], rest))
    y = pd.Series(x).ewm(alpha=1.0 / p, adjust=False).mean().to_numpy(copy=True)
    gone = np.isnan(x)
    if gone.any():
        y[int(np.argmax(gone)):] = np.nan
    return y


def _wilder_sum(x: np.ndarray, p: int) -> np.ndarray:
    """The sum of the first `p` values, then s = s - s/p + x, which is p times the smoothing of x."""
    return p * _smooth(x[:p].sum() / p, x[p:], p)


@dataclass(frozen=True)
class Diff:
    k: int = 1

    @property
    def name(self) -> str:
        return f"_diff_{self.k}"

    @property
    def lookback(self) -> int:
        return self.k

    def apply(self, col: Column, frame: Frame) -> Column:
        return col - F.lag(col, self.k).over(frame.ordered)


@dataclass(frozen=True)
class Lag:
    """The value k rows before; a negative k looks ahead."""

    k: int = 1

    @property
    def name(self) -> str:
        return f"_lag_{self.k}"

    @property
    def lookback(self) -> int:
        return self.k

    def apply(self, col: Column, frame: Frame) -> Column:
        return F.lag(col, self.k).over(frame.ordered)


@dataclass(frozen=True)
class Rescale:
    """Linear map of [old_min, old_max] to [new_min, new_max] without clipping; unchanged if the old range is empty."""

    old_min: float
    old_max: float
    new_min: float = 0.0
    new_max: float = 1.0
    lookback: int = field(default=0, init=False)

    @property
    def name(self) -> str:
        return f"_rescale_{self.old_min}_{self.old_max}"

    def apply(self, col: Column, frame: Frame) -> Column:
        span = self.old_max - self.old_min
        if span == 0:
            return col
        return (col - F.lit(float(self.old_min))) / F.lit(float(span)) * F.lit(float(self.new_max - self.new_min)) + F.lit(float(self.new_min))


@dataclass(frozen=True)
class ZScore:
    """Distance from the mean of the last `window` values in sample standard deviations; null for a deviation of zero or too few values."""

    window: int

    @property
    def name(self) -> str:
        return f"_zscore_{self.window}"

    @property
    def lookback(self) -> int:
        return self.window

    def apply(self, col: Column, frame: Frame) -> Column:
        w = frame.last(self.window)
        sd = F.stddev_samp(col).over(w)
        return F.when((F.count(col).over(w) == self.window) & (F.min(col).over(w) != F.max(col).over(w)) & (sd > 0), (col - F.avg(col).over(w)) / sd)


@dataclass(frozen=True)
class _Made:
    """An indicator whose columns were made from the whole series before it was split."""

    name: str
    outputs: tuple[str, ...]
    lookback: int = 0

    def columns(self, frame: Frame) -> dict[str, Column]:
        return {n: F.col(f"_whole_{n}") for n in self.outputs}


@dataclass(frozen=True)
class FeatureSpec:
    base: Indicator | Recurrence
    transforms: tuple[Transform, ...] = ()
    alias: str | None = None

    @property
    def name(self) -> str:
        return self.alias or self.base.name + "".join(t.name for t in self.transforms)

    @property
    def lookback(self) -> int:
        return self.base.lookback + sum(t.lookback for t in self.transforms)


class FeaturePipeline:
    """Adds the columns of all specs to the bars.

    `transform` keeps the rows and columns it gets; `features` gives keys, time and the feature columns in order of their names. An indicator with
    several columns keeps their names and ignores the alias. Two features of one name, or one named like a column of the bars, are an error.
    """

    def __init__(self, specs: list[FeatureSpec], keys: tuple[str, ...] = ("symbol",), time: str = "time"):
        self.specs, self.frame = list(specs), Frame(tuple(keys), time)

    @property
    def max_lookback(self) -> int:
        return max((s.lookback for s in self.specs), default=0)

    def names(self, bars: DataFrame | None = None) -> list[str]:
        names = [n for s in self.specs for n in self._outputs(s)]
        twice = {n for n in names if names.count(n) > 1} | (set(names) & set(bars.columns) if bars is not None else set())
        if twice:
            raise ValueError(f"Duplicate feature names: {', '.join(sorted(twice))}")
        return sorted(names)

    def _outputs(self, spec: FeatureSpec) -> list[str]:
        many = getattr(spec.base, "outputs", None)
        return [m + "".join(t.name for t in spec.transforms) for m in many] if many and len(many) > 1 else [spec.name]

    def transform_split(self, bars: DataFrame, block_rows: int = 50_000, sizes: DataFrame | None = None) -> DataFrame:
        """Like `transform`, with every series cut into blocks of about `block_rows` bars, for series too long for one task.

        A block sees as many bars before it, and after it, as its features look back and ahead; averages with endless memory get as many as still
        show in a double, so they equal those of the whole series but for the last digits, as long as no stretch without values is longer than that.
        `sizes` may be a table with the same keys and times that is cheaper to count, such as the one the bars were made from.
        Recurrences with `splits` False (an ADX can stay null for good) are folded over whole series first, each in one task.
        """
        require_ohlcv(bars)
        self.names(bars)
        specs, whole = [], []
        for s in self.specs:
            if isinstance(s.base, Recurrence) and not getattr(s.base, "splits", True):
                whole.append(s.base)
                made = tuple(getattr(s.base, "outputs", None) or [s.base.name])
                s = FeatureSpec(_Made(s.base.name, made), s.transforms, s.alias)
            specs.append(s)
        outputs = sorted({n for s in specs if isinstance(s.base, _Made) for n in s.base.outputs})
        folded = fold_features(bars, whole, self.frame)
        ready = folded.select(*bars.columns, *[F.col(n).alias(f"_whole_{n}") for n in outputs])
        back = [s.base.lookback + sum(max(t.lookback, 0) for t in s.transforms) for s in specs]
        memory = max([0, *back, *(s.base.memory + n for s, n in zip(specs, back) if isinstance(s.base, Recurrence))])
        ahead = max((sum(max(-t.lookback, 0) for t in s.transforms) for s in specs), default=0)
        keys, time = list(self.frame.keys), self.frame.time
        us = F.unix_micros(F.to_timestamp(time))
        core = with_blocks(ready.withColumn("_us", us), keys, "_us", max(block_rows, 10 * (memory + ahead)), sizes=None if sizes is None else sizes.withColumn("_us", us)).drop("_us")
        both = core.withColumn("_mine", F.lit(True))
        for rows, after in ((memory, False), (ahead, True)):
            if rows:
                both = both.unionByName(halo(core, keys, time, rows, after).withColumn("_mine", F.lit(False)))
        inner = FeaturePipeline(specs, (*keys, "_block"), time)
        return inner.transform(both).where("_mine").drop("_mine", "_block", *[f"_whole_{n}" for n in outputs])

    def transform(self, bars: DataFrame) -> DataFrame:
        require_ohlcv(bars)
        for s in self.specs:
            lost = [c for c in getattr(s.base, "sources", ()) if c not in bars.columns]
            if lost:
                raise ValueError(f"Source column not found: {', '.join(lost)}")
        names = self.names(bars)
        out = fold_features(bars, [s.base for s in self.specs if isinstance(s.base, Recurrence)], self.frame)
        stages: list[dict[str, Column]] = [{}]
        for s in self.specs:
            if hasattr(s.base, "stages"):
                made = s.base.stages(self.frame)
                stages = [{} for _ in range(len(made) - len(stages))] + stages
                for k, stage in enumerate(reversed(made), 1):
                    stages[-k].update(stage)
            elif not isinstance(s.base, Recurrence):
                stages[-1].update(s.base.columns(self.frame))
        for stage in stages:
            stage = {k: v for k, v in stage.items() if k not in out.columns}
            out = out.withColumns(stage) if stage else out
        # each round applies the next transform of every spec
        current: dict[str, Column] = {}
        pending = []
        for s in self.specs:
            bases = getattr(s.base, "outputs", None) or [s.base.name]
            for base, name in zip(bases, self._outputs(s)):
                current[name] = F.col(base)
                pending.append((base, name, list(s.transforms)))
        temp = {name: f"_f{i}" for i, (_, name, _) in enumerate(pending)}
        out = out.withColumns({temp[name]: F.col(base) for base, name, _ in pending}) if pending else out
        for depth in range(max((len(t) for _, _, t in pending), default=0)):
            out = out.withColumns({temp[n]: t[depth].apply(F.col(temp[n]), self.frame) for _, n, t in pending if depth < len(t)})
        return out.select(*bars.columns, *[F.col(temp[n]).alias(n) for n in names])

    def features(self, bars: DataFrame, split: bool = False, sizes: DataFrame | None = None) -> DataFrame:
        done = self.transform_split(bars, sizes=sizes) if split else self.transform(bars)
        return done.select(*self.frame.keys, self.frame.time, *self.names())


def fold_features(bars: DataFrame, recurrences: list[Recurrence], frame: Frame) -> DataFrame:
    """Add the columns of recurrences, all in one pass over each series.

    A group goes through one task: a whole series in `transform` (at five-minute bars a century is ten million rows), a block in `transform_split`.
    """
    todo = list({r.name: r for r in recurrences}.values())
    if not todo:
        return bars
    ship(bars.sparkSession)
    outputs = [n for r in todo for n in (getattr(r, "outputs", None) or [r.name])]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(frame.time, kind="stable")
        made = {k: v for r in todo for k, v in r.fold(pdf).items()}
        return pdf.assign(**made)

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in bars.schema.fields], *[f"`{n}` double" for n in outputs]])
    folded = bars.groupBy(*frame.keys).applyInPandas(run, schema)
    return folded.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in outputs})
