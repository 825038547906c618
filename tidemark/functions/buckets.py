"""Signed logarithmic buckets of numbers: the values of a bucket differ by at most a fixed factor, so its middle is within a fixed relative error of each."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The buckets are this much narrower than the promise, so rounding in the logarithm can't break it.
SLACK = 0.999


def log_width(error: float) -> float:
    """Natural logarithm of the ratio of a bucket's bounds, (1+e)/(1-e)."""
    if not 0 < error < 1:
        raise ValueError("error must be between 0 and 1")
    e = error * SLACK
    return math.log((1 + e) / (1 - e))


def bucket(col: Column, error: float) -> Column:
    """Signed bucket as a struct of sign (-1, 0, 1) and index; infinities have one bucket each at the far ends."""
    mag = F.abs(col)
    big = F.lit(float("inf"))
    idx = F.when(mag == big, F.lit(2**31 - 1)).when(mag == 0, F.lit(0)).otherwise(F.ceil(F.log(mag) / F.lit(log_width(error))).cast("int"))
    return F.struct(F.signum(col).cast("int").alias("sgn"), idx.cast("int").alias("idx"))


def middle(sgn: Column, idx: Column, error: float) -> Column:
    """The value within `error`, relatively, of all values of a bucket; 0 for that of zero."""
    width = log_width(error)
    return F.when(sgn == 0, F.lit(0.0)).otherwise(sgn * F.exp((idx - 1) * F.lit(width)) * F.lit(2 * math.exp(width) / (math.exp(width) + 1)))


def order(sgn: Column, idx: Column) -> Column:
    """A number that orders buckets by their values."""
    return sgn * idx.cast("bigint") + sgn.cast("bigint") * F.lit(2**33)
