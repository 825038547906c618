"""Signals as columns: direction (1, -1, 0), strength and reason."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.features import ADX, EMA, SMA, FeatureSpec, Frame

WARMUP = "warmup/feature_nan"


@dataclass(frozen=True)
class Crossover:
    """Level comparison of a fast and a slow average on every bar; with `adx`, flat while it is below the threshold.

    Features that are missing on a bar, or don't exist, keep the strategy flat. `digits` rounds the averages before they are compared.
    """

    fast: str
    slow: str
    warmup_bars: int
    adx: str | None = None
    adx_threshold: float = 25.0
    digits: int | None = None

    @property
    def required(self) -> tuple[str, ...]:
        return (self.fast, self.slow) + ((self.adx,) if self.adx else ())

    def signal(self, available: list[str], bar_index: Column) -> Column:
        row = lambda d, s, r: F.struct(F.lit(d).cast("double").alias("direction"), F.lit(s).cast("double").alias("strength"), F.lit(r).alias("reason"))
        if any(c not in available for c in self.required):
            return row(0, 0, WARMUP)
        ready = bar_index >= self.warmup_bars
        for c in self.required:
            ready = ready & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
        level = lambda c: F.round(c, self.digits) if self.digits is not None else F.col(c)
        fast, slow = level(self.fast), level(self.slow)
        out = F.when(~ready, row(0, 0, WARMUP))
        if self.adx:
            out = out.when(level(self.adx) < self.adx_threshold, row(0, 0, "adx_below_threshold"))
        return out.when(fast > slow, row(1, 1, "cross_above")).when(fast < slow, row(-1, 1, "cross_below")).otherwise(row(0, 0, "equal"))


def with_signal(bars: DataFrame, strategy, frame: Frame) -> DataFrame:
    """Add `direction`, `strength` and `reason` to bars that have the strategy's features; columns of these names are replaced."""
    kept = [c for c in bars.columns if c not in ("direction", "strength", "reason")]
    staged = bars.withColumn("_index", F.row_number().over(frame.ordered) - 1)
    return staged.withColumn("_signal", strategy.signal(bars.columns, F.col("_index"))).select(*kept, "_signal.*")


_BUILDERS: dict[str, Callable] = {}


def register(name: str, builder: Callable) -> None:
    """`builder` takes the options of a strategy and returns the strategy and its feature specs."""
    _BUILDERS[name] = builder


def build_strategy(config: dict):
    """Build the strategy that `config["type"]` names; the other entries are its options. `config` stays as it is."""
    options = dict(config)
    if "type" not in options:
        raise ValueError("Strategy config must contain a 'type' key")
    kind = options.pop("type")
    if kind not in _BUILDERS:
        raise ValueError(f"Unknown strategy type: {kind!r}; known: {', '.join(sorted(_BUILDERS))}")
    return _BUILDERS[kind](**options)


def _averages(fast_period: int, slow_period: int, indicator_type: str):
    make = EMA if indicator_type == "ema" else SMA
    return make(fast_period), make(slow_period)


def ma_crossover(fast_period: int, slow_period: int, indicator_type: str = "sma", digits: int | None = None):
    fast, slow = _averages(fast_period, slow_period, indicator_type)
    return Crossover(fast.name, slow.name, slow_period, digits=digits), [FeatureSpec(fast), FeatureSpec(slow)]


def adx_filtered(fast_period: int, slow_period: int, indicator_type: str = "sma", adx_period: int = 14, adx_threshold: float = 25.0, digits: int | None = None):
    fast, slow = _averages(fast_period, slow_period, indicator_type)
    adx = ADX(adx_period)
    made = Crossover(fast.name, slow.name, max(slow_period, 2 * adx_period), adx.name, adx_threshold, digits)
    return made, [FeatureSpec(fast), FeatureSpec(slow), FeatureSpec(adx)]


register("ma_crossover", ma_crossover)
register("adx_filtered", adx_filtered)
