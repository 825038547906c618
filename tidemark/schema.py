"""Schemas of bars, trades and equity, and how raw bars become canonical."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_BARS = T.StructType([
    T.StructField("time", T.TimestampType()), *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close")],
    *[T.StructField(c, T.LongType()) for c in ("tick_volume", "spread", "real_volume")],
])
BAR_COLUMNS = RAW_BARS.fieldNames()
OHLCV = ("open", "high", "low", "close", "volume")


def coalesce_volume(bars: DataFrame) -> DataFrame:
    """Add `volume` from `tick_volume`, else from `real_volume`; the choice is by which column exists, and it stays."""
    if "volume" in bars.columns:
        return bars
    for name in ("tick_volume", "real_volume"):
        if name in bars.columns:
            return bars.withColumn("volume", F.col(name))
    return bars


def require_ohlcv(bars: DataFrame) -> None:
    lost = [c for c in OHLCV if c not in bars.columns]
    if lost:
        raise ValueError(f"OHLCV data lacks the columns: {', '.join(lost)}")


def missing_as_null(df: DataFrame) -> DataFrame:
    """NaN becomes null in every floating column, so comparisons with missing values are never true."""
    return df.withColumns({
        f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    })
