"""Irregular readings onto a regular grid.

Readings are first reduced to one row per source and slot, combined before they are
shuffled, so a source is never larger than its number of slots. Slots then meet their neighbours as of
their time within blocks, the edges of the blocks in a much smaller table of block
ends; one hot source is thereby spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.cols import require

_EDGE = ("_slot", "_n", "_lt", "_lv", "_ns", "_nt", "_nv")
RUN = 4096  # slots generated per row of the first of two expansions


def regrid(
    df: DataFrame,
    source: tuple[str, ...] = ("broker", "symbol"),
    time: str = "time",
    value: str = "close",
    step_s: int = 300,
    max_gap_s: int = 3600,
    version: str | None = "arrived_utc",
    block_slots: int = 2016,
) -> DataFrame:
    """One row per source and slot, from its first to its last slot with a value.

    Slot k covers `[k*step_s, (k+1)*step_s)` epoch seconds. Returns the source columns,
    `slot_epoch` (start of the slot), `value`, `status` and `n_readings`:

    * `observed`: the value is that of the last reading in the slot;
    * `filled`: no reading; the value is interpolated linearly in time, at the slot's start, between
      the last reading before and the first after, which are at most `max_gap_s` apart;
    * `missing`: no reading and the neighbours are further apart; the value is null.

    Missing values (null, NaN) and null times are no readings; a source without any is not in the result.
    Of readings with the same source and time the one with the greatest `version` holds, then the greatest value;
    they count once per distinct time in the ordering but each in `n_readings`. Null source columns form a
    source of their own. Extra columns are ignored; an empty table gives an empty result.
    """
    require(df, *source, time, value)
    keys = [f"_s{i}" for i in range(len(source))]
    val = F.col(value).cast("double")
    us = F.unix_micros(F.col(time).cast("timestamp"))
    ver = F.unix_micros(F.col(version).cast("timestamp")) if version and version in df.columns else F.lit(0).cast("bigint")
    read = df.where(F.col(time).isNotNull() & val.isNotNull() & ~F.isnan(val)).select(
        *[F.col(s).alias(k) for s, k in zip(source, keys)], us.alias("_t"), val.alias("_v"), F.coalesce(ver, F.lit(-(2**62))).alias("_ver"),
    ).withColumn("_slot", F.floor(F.col("_t") / F.lit(step_s * 1_000_000)).cast("bigint"))
    slots = read.groupBy(*keys, "_slot").agg(
        F.max(F.struct("_t", "_ver", "_v")).alias("_last"),
        F.min(F.struct(F.col("_t"), (-F.col("_ver")).alias("_nver"), (-F.col("_v")).alias("_nv"))).alias("_first"),
        F.count(F.lit(1)).alias("_n"),
    ).select(
        *keys, "_slot", "_n", F.col("_last._t").alias("_lt"), F.col("_last._v").alias("_lv"),
        F.col("_first._t").alias("_ft"), (-F.col("_first._nv")).alias("_fv"),
        F.floor(F.col("_slot") / F.lit(block_slots)).cast("bigint").alias("_block"),
    )
    # Within a block a slot's right neighbour is the next row. The last slot of a block meets the first one of the source's next block in a
    # table of one row per block, so the slots themselves are never joined. Single columns, not structs: both sides then need the same
    # ones and share the exchange of the slots.
    inside = Window.partitionBy(*keys, "_block").orderBy("_slot")
    follow = {"_ns": F.lead("_slot").over(inside), "_nt": F.lead("_ft").over(inside), "_nv": F.lead("_fv").over(inside)}
    within = slots.withColumns(follow).where(F.col("_ns").isNotNull()).select(*keys, *_EDGE)
    ends = slots.groupBy(*keys, "_block").agg(
        F.min("_slot").alias("_hs"), F.min_by("_ft", "_slot").alias("_ht"), F.min_by("_fv", "_slot").alias("_hv"), F.max("_slot").alias("_s"),
        *[F.max_by(c, "_slot").alias(c) for c in ("_n", "_lt", "_lv")],
    ).withColumnRenamed("_s", "_slot")
    blocks = Window.partitionBy(*keys).orderBy("_block")
    across = ends.withColumns({n: F.lead(h).over(blocks) for n, h in (("_ns", "_hs"), ("_nt", "_ht"), ("_nv", "_hv"))}).select(*keys, *_EDGE)
    return _expand(within.unionByName(across), source, keys, step_s, max_gap_s)


def _expand(edge: DataFrame, source, keys, step_s: int, max_gap_s: int) -> DataFrame:
    stop = F.coalesce(F.col("_ns") - 1, F.col("_slot"))
    runs = edge.withColumn("_stop", stop).withColumn("_from", F.explode(F.sequence("_slot", "_stop", F.lit(RUN).cast("bigint"))))
    grid = runs.withColumn("_k", F.explode(F.sequence("_from", F.least(F.col("_from") + (RUN - 1), F.col("_stop")))))
    seen = F.col("_k") == F.col("_slot")
    gap = F.col("_nt") - F.col("_lt")
    at = F.col("_k") * F.lit(step_s * 1_000_000)
    between = F.col("_lv") + (F.col("_nv") - F.col("_lv")) * ((at - F.col("_lt")) / gap)
    near = gap <= F.lit(max_gap_s * 1_000_000)
    return grid.select(
        *[F.col(k).alias(s) for s, k in zip(source, keys)],
        (F.col("_k") * step_s).alias("slot_epoch"),
        F.when(seen, F.col("_lv")).when(near, between).alias("value"),
        F.when(seen, "observed").when(near, "filled").otherwise("missing").alias("status"),
        F.when(seen, F.col("_n")).otherwise(F.lit(0)).cast("bigint").alias("n_readings"),
    )


def empty_slots(grid: DataFrame) -> DataFrame:
    """Slots without a reading, filled or not."""
    return grid.where(F.col("status") != "observed")
