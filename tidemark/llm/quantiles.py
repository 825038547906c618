"""Percentiles of very large numeric columns, from mergeable signed logarithmic buckets.

A sketch is an ordinary table: one row per group and bucket with its count. Sketches of parts
or days are combined by adding the counts of equal buckets, and any percentile is read from the
running count. A bucket's values differ by at most the factor (1+e)/(1-e), so the value returned
is within e of the true one, relative to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import buckets
from tidemark.functions.cols import require, round_sig

_COLUMNS = ("sgn", "idx", "n", "lo", "hi", "_v", "_b", "_c", "_n")


def sketch(df: DataFrame, by: list[str], value: str, error: float = 0.01) -> DataFrame:
    """Count the values of each group in signed logarithmic buckets.

    Returns the group columns, `sgn`, `idx`, `n`, `lo` and `hi` (smallest and greatest value in the bucket).
    Null and NaN are left out; zeros of both signs share a bucket; infinities have their own. Null group
    values form a group. The counts are combined on the map side, so a hot group costs its number of
    buckets, not of rows. An empty table gives an empty sketch. Extra columns are
    ignored; group columns may not be named like the sketch's own.
    """
    require(df, *by, value)
    taken = {*_COLUMNS, "p", "n_values", "estimate"} & set(by)
    if taken:
        raise ValueError(f"Group columns named like those of a sketch: {', '.join(sorted(taken))}")
    val = F.col(value).cast("double")
    keep = df.select(*by, val.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    # adding 0.0 turns -0.0 into 0.0
    return (
        keep.withColumn("_v", F.col("_v") + F.lit(0.0)).withColumn("_b", buckets.bucket(F.col("_v"), error))
        .groupBy(*by, F.col("_b.sgn").alias("sgn"), F.col("_b.idx").alias("idx"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    )


def merge_sketches(parts: DataFrame, by: list[str]) -> DataFrame:
    """Add up sketches (of the same error) to the coarser groups `by`; the order of merging doesn't matter."""
    return parts.groupBy(*by, "sgn", "idx").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def percentiles(sk: DataFrame, by: list[str], ps: list[float], error: float = 0.01) -> DataFrame:
    """Read percentiles from a sketch: one row per group and `p`.

    `estimate` is within `error`, relatively, of the value of rank floor(p*(n-1)) of the sorted values
    (rank 0 is the smallest). `n_values` is the number of values of the group.
    A group's window holds its buckets only.
    """
    if any(not 0 <= p <= 1 for p in ps):
        raise ValueError("percentiles are between 0 and 1")
    run = Window.partitionBy(*by).orderBy(buckets.order(F.col("sgn"), F.col("idx")))
    cum = sk.withColumn("_c", F.sum("n").over(run.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "_n", F.sum("n").over(Window.partitionBy(*by))
    )
    rank = F.floor(F.col("p") * (F.col("_n") - 1)).cast("bigint")
    # never outside the values that were really there
    est = F.when(F.col("sgn") == 0, F.lit(0.0)).otherwise(F.greatest(F.col("lo"), F.least(F.col("hi"), buckets.middle(F.col("sgn"), F.col("idx"), error))))
    hit = cum.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in ps]))).where(
        (rank >= F.col("_c") - F.col("n")) & (rank < F.col("_c"))
    )
    return hit.select(*by, "p", F.col("_n").alias("n_values"), round_sig(est, 12).alias("estimate"))


def once(df: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of rows that may be delivered twice, each row once.

    Rows are told apart by two 64-bit hashes of all their columns, so that only these and the kept columns are shuffled.
    """
    cols = [F.col(c) for c in df.columns]
    marks = [F.xxhash64(F.lit(k), *cols).alias(f"_h{k}") for k in (1, 2)]
    return df.select(*keep, *marks).distinct().select(*keep)


def live_sketch(values: DataFrame, by: list[str], value: str, time: str, window: str = "1 day", late: str = "2 days", error: float = 0.01) -> DataFrame:
    """The bucket counts of `sketch` of a stream per window of event time, final once the watermark has passed; later values are dropped.

    Finished windows merge with `merge_sketches` like any other parts.
    """
    v = F.col(value).cast("double") + F.lit(0.0)
    rows = values.withWatermark(time, late).where(v.isNotNull() & ~F.isnan(v)).withColumn("_v", v).withColumn("_b", buckets.bucket(F.col("_v"), error))
    counts = rows.groupBy(F.window(time, window).alias("_w"), *by, F.col("_b.sgn").alias("sgn"), F.col("_b.idx").alias("idx")).agg(
        F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")
    )
    return counts.select(F.col("_w.start").alias("from_time"), *by, "sgn", "idx", "n", "lo", "hi")
