"""Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def missing(col: Column, is_float: bool = True) -> Column:
    """True where a value is null, or NaN for floating columns."""
    return col.isNull() | F.isnan(col) if is_float else col.isNull()


def no_nan(col: Column) -> Column:
    """NaN becomes null; everything else stays."""
    return F.when(~F.isnan(col), col)


def epoch_seconds(col: Column) -> Column:
    return F.unix_seconds(col)


def require(df: DataFrame, *names: str) -> None:
    """Raise a clear error when columns are absent."""
    lost = [n for n in names if n not in df.columns]
    if lost:
        raise ValueError(f"Missing columns: {', '.join(lost)}")


def round_sig(col: Column, digits: int = 7) -> Column:
    """Round to significant digits; the same text format exists in other engines."""
    return F.when(col.isNotNull(), F.format_string(f"%.{digits - 1}e", col).cast("double"))
