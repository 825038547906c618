"""What changed between full snapshots.

Every record key is windowed over the index of its snapshot within its chain. A lagged hash
of the compared values tells whether a record changed, a jump of the index tells that the
record went missing in between and came back. One row of the input gives at most one row
of "added" or "changed" and one of "removed", so nothing is joined with itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.cols import require


def chain_name(col: Column) -> Column:
    """Names that differ in case or in blanks around only are one chain."""
    return F.upper(F.regexp_replace(col, r"^[\s ]+|[\s ]+$", ""))


def index_snapshots(meta: DataFrame, chain: list[str], snapshot: str = "snapshot_id") -> DataFrame:
    """Number the snapshots of each chain.

    Returns one row per chain and snapshot: the chain columns `_c0.._cn` (normalised), the
    snapshot, `_idx` from 1, and `_next`, the id of the following snapshot (null for
    the last). Rows without a snapshot id are left out; rows that are there twice count once.
    Null chain values form a chain of their own.
    """
    require(meta, snapshot, *chain)
    names = [f"_c{i}" for i in range(len(chain))]
    rows = meta.where(F.col(snapshot).isNotNull()).select(
        *[chain_name(F.col(c)).alias(n) for c, n in zip(chain, names)], F.col(snapshot).alias("_snap")
    ).distinct()
    w = Window.partitionBy(*names).orderBy("_snap")
    return rows.select(*names, "_snap", F.row_number().over(w).alias("_idx"), F.lead("_snap").over(w).alias("_next"))


def snapshot_changes(
    bars: DataFrame,
    meta: DataFrame,
    key: str = "time",
    value: str = "close",
    chain: tuple[str, ...] = ("broker", "symbol"),
    snapshot: str = "snapshot_id",
    tolerance: float = 1e-6,
) -> DataFrame:
    """Records added, removed or changed between consecutive snapshots of a chain.

    Returns `snapshot_id` (the later one), the key, `change_kind`, `old_value`, `new_value`,
    each case once. Values differ when they are further apart than `tolerance` or
    one of them is missing (null and NaN are both missing). Rows with a null key or
    snapshot id, and snapshots that `meta` doesn't know, take no part. A key that is twice in one
    snapshot counts once, with its greatest value that isn't missing. A snapshot known to `meta` without
    any records removes all of its predecessor's. Other columns of both tables are ignored.
    Empty tables give an empty result.
    """
    require(bars, snapshot, key, value)
    index = index_snapshots(meta, list(chain), snapshot)
    names = [f"_c{i}" for i in range(len(chain))]
    val = F.col(value).cast("double")
    rows = (
        bars.where(F.col(key).isNotNull() & F.col(snapshot).isNotNull())
        .select(F.col(snapshot).alias("_snap"), F.col(key).alias("_key"), F.when(~F.isnan(val), val).alias("_v"))
        .join(index, "_snap")
    )
    # One exchange serves both the removal of repeated rows and the window below.
    once = (
        rows.repartition(*names, "_key")
        .groupBy(*names, "_key", "_idx")
        .agg(F.max("_v").alias("_v"), F.first("_snap").alias("_snap"), F.first("_next").alias("_next"))
    )
    w = Window.partitionBy(*names, "_key").orderBy("_idx")
    seen = once.withColumn("_h", F.xxhash64("_v")).select(
        "_key", "_v", "_snap", "_next", "_idx", "_h",
        F.lag("_idx").over(w).alias("_pi"), F.lag("_h").over(w).alias("_ph"), F.lag("_v").over(w).alias("_pv"),
        F.lead("_idx").over(w).alias("_ni"),
    )
    apart = F.when(F.col("_v").isNull() | F.col("_pv").isNull(), F.col("_v").isNotNull() | F.col("_pv").isNotNull()).otherwise(
        F.abs(F.col("_v") - F.col("_pv")) > F.lit(tolerance)
    )
    none = F.lit(None).cast("double")
    came = F.when(
        (F.col("_idx") > 1) & (F.col("_pi").isNull() | (F.col("_pi") < F.col("_idx") - 1)),
        F.struct(F.col("_snap").alias("s"), F.lit("added").alias("k"), none.alias("o"), F.col("_v").alias("n")),
    ).when(
        (F.col("_pi") == F.col("_idx") - 1) & (F.col("_ph") != F.col("_h")) & apart,
        F.struct(F.col("_snap").alias("s"), F.lit("changed").alias("k"), F.col("_pv").alias("o"), F.col("_v").alias("n")),
    )
    went = F.when(
        F.col("_next").isNotNull() & (F.col("_ni").isNull() | (F.col("_ni") > F.col("_idx") + 1)),
        F.struct(F.col("_next").alias("s"), F.lit("removed").alias("k"), F.col("_v").alias("o"), none.alias("n")),
    )
    return (
        seen.select("_key", F.explode(F.filter(F.array(came, went), lambda x: x.isNotNull())).alias("_x"))
        .select(
            F.col("_x.s").alias("snapshot_id"), F.col("_key").alias(key), F.col("_x.k").alias("change_kind"),
            F.col("_x.o").alias("old_value"), F.col("_x.n").alias("new_value"),
        )
    )


def change_summary(changes: DataFrame) -> DataFrame:
    """Number of changes by snapshot and kind, aggregated before it is shuffled."""
    return changes.groupBy("snapshot_id", "change_kind").agg(F.count(F.lit(1)).alias("n_changes"))
