"""Checks of bars before they are used: one aggregation for all counts, then the first failure in order is raised."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICES = ("open", "high", "low", "close")
ARRIVAL = "_arrival"


def validation_counts(bars: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per key with the numbers of faults.

    `n_rows`, `null_times`, `duplicate_times` (beyond the first of a time), `out_of_order` (earlier than the bar before in
    order of arrival; 0 without an arrival column), `missing_<price>` (null or NaN, for the prices there are) and `negative_spreads`. Null
    spreads are fine. Times are counted per key in a first aggregation that combines before it shuffles; only the check
    of arrival order windows single bars, of a scanned snapshot by split of its files. An empty table gives no row with keys, and one of zeros without.
    """
    keys = keys or []
    if "time" not in bars.columns:
        raise ValueError("Missing 'time' column")
    prices = [c for c in PRICES if c in bars.columns]
    floating = {f.name for f in bars.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    gone = {c: F.col(c).isNull() | (F.isnan(c) if c in floating else F.lit(False)) for c in prices}
    rows = bars
    late = F.lit(0)
    if ARRIVAL in bars.columns:
        parts = [ARRIVAL + "." + c for c in ("file", "at")] if isinstance(bars.schema[ARRIVAL].dataType, T.StructType) and {"file", "at"} <= set(bars.schema[ARRIVAL].dataType.names) else []
        w = Window.partitionBy(*keys, *parts).orderBy(ARRIVAL)
        rows = bars.withColumn("_late", F.lag("time").over(w) > F.col("time"))
        late = F.count_if("_late")
    spread = F.count_if(F.col("spread") < 0) if "spread" in bars.columns else F.lit(0)
    per_time = rows.groupBy(*keys, "time").agg(
        F.count(F.lit(1)).alias("_n"), late.cast("bigint").alias("_late"), spread.cast("bigint").alias("_spread"), *[F.count_if(g).alias(f"_{c}") for c, g in gone.items()]
    )
    if ARRIVAL in bars.columns and parts:
        # bars were compared within splits of files; between splits only their ends meet, of which there is a row for each split
        ends = bars.groupBy(*keys, *[F.col(c).alias(f"_{i}") for i, c in enumerate(parts)]).agg(F.min_by("time", ARRIVAL).alias("_first"), F.max_by("time", ARRIVAL).alias("_last"))
        seam = F.lag("_last").over(Window.partitionBy(*keys).orderBy("_0", "_1")) > F.col("_first")
        zero = {c: F.lit(0).cast("bigint") for c in ("_n", "_spread", *[f"_{c}" for c in gone])}
        seams = ends.withColumn("_seam", seam).where("_seam").select(*keys, F.col("_first").alias("time"), F.lit(1).cast("bigint").alias("_late"), *[v.alias(k) for k, v in zero.items()])
        per_time = per_time.unionByName(seams).groupBy(*keys, "time").agg(*[F.sum(c).alias(c) for c in ("_n", "_late", "_spread", *[f"_{c}" for c in gone])])
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    known = F.col("time").isNotNull()
    return per_time.groupBy(*keys).agg(
        total("_n").alias("n_rows"), total(F.when(~known, F.col("_n"))).alias("null_times"), total(F.when(known, F.col("_n") - 1)).alias("duplicate_times"),
        total("_late").alias("out_of_order"), *[total(f"_{c}").alias(f"missing_{c}") for c in prices], total("_spread").alias("negative_spreads"),
    )


def validate_bars(bars: DataFrame, keys: list[str] | None = None) -> None:
    """Raise ValueError at the first kind of fault: null, duplicate, unordered times, missing prices, negative spreads."""
    counts = validation_counts(bars, keys)
    sums = counts.agg(*[F.sum(c).alias(c) for c in counts.columns if c not in (keys or [])]).first().asDict()
    sums = {k: v or 0 for k, v in sums.items()}
    if not sums["n_rows"]:
        raise ValueError("No bars")
    if sums["null_times"]:
        raise ValueError(f"Null timestamps: {sums['null_times']}")
    if sums["duplicate_times"]:
        raise ValueError(f"Duplicate timestamps: {sums['duplicate_times']}")
    if sums["out_of_order"]:
        raise ValueError("Timestamps are not monotonic in order of arrival")
    lost = [c for c in PRICES if sums.get(f"missing_{c}")]
    if lost:
        raise ValueError("NaN values in OHLC columns: " + ", ".join(f"{c} ({sums[f'missing_{c}']})" for c in lost))
    if sums["negative_spreads"]:
        raise ValueError(f"Negative spread values: {sums['negative_spreads']}")


def first_wins(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Union of two bar tables in which, of equal keys, the existing row holds, then the one that arrived first.

    Order of arrival is the column `_arrival` if both have it; else equal new rows are told apart by their values, the smallest first. Columns that
    only one side has are null on the other.
    """
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    order = [ARRIVAL] if ARRIVAL in existing.columns and ARRIVAL in new.columns else [c for c in existing.columns if c not in keys]
    w = Window.partitionBy(*keys).orderBy("_new", *order)
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_new")


def canonical(bars: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Bars with `time` as a timestamp, sorted by key and time within partitions."""
    if "time" not in bars.columns:
        raise ValueError("Missing 'time' column")
    return bars.withColumn("time", F.col("time").cast("timestamp")).sortWithinPartitions(*(keys or []), "time")
