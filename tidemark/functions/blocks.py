"""Cutting ordered series into blocks of bounded size, with rows of their neighbours where an operator looks beyond a block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LONGEST_US = 180 * 86_400_000_000


def same_keys(keys: list[str], suffix: str) -> Column:
    """Null-safe equality of every key with its namesake with the suffix."""
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(k + suffix))
    return same


def with_blocks(rows: DataFrame, keys: list[str], us: str, size: int = 50_000, few: int = 10_000, sizes: DataFrame | None = None) -> DataFrame:
    """Add `_block`: a number of stretches of time in which no source is expected to have more than `size` readings.

    The stretch is the source's own, from its hour with most readings (counted before anything is shuffled), at most 180 days. The table of
    stretches has a row per source; where rows are dear to make, `sizes`, a table with the same keys and times and at least as many rows, is counted in their place. It is broadcast only if it was seen to have at most `few` rows, and joined like any table otherwise.
    """
    hour = F.floor(F.col(us) / F.lit(3_600_000_000)).cast("bigint")
    per_hour = (rows if sizes is None else sizes).groupBy(*keys, hour.alias("_hour")).agg(F.count(F.lit(1)).alias("_n"))
    span = F.least(F.lit(LONGEST_US), F.greatest(F.lit(1_000_000), F.floor(F.lit(3_600_000_000) * F.lit(size) / F.max("_n")))).cast("bigint")
    spans = per_hour.groupBy(*keys).agg(span.alias("_span")).select(*[F.col(k).alias(f"{k}p") for k in keys], "_span")
    seen = spans.take(few + 1)
    if len(seen) <= few:
        spans = F.broadcast(rows.sparkSession.createDataFrame(seen, spans.schema))
    block = F.floor(F.col(us) / F.col("_span")).cast("bigint")
    return rows.join(spans, same_keys(keys, "p")).withColumn("_block", block).drop("_span", *[f"{k}p" for k in keys])


def halo(core: DataFrame, keys: list[str], order: str, rows: int, after: bool = False) -> DataFrame:
    """For every block the `rows` rows before it (or after it), as rows under that block's number.

    However few rows the blocks have, each gets as many as there are. Only the rows at the edges of blocks move; which block they go to is
    found in a table of one row per block.
    """
    at = [*keys, "_block"]
    edge_order, block_order = (F.asc(order), F.desc("_block")) if after else (F.desc(order), F.asc("_block"))
    edge = core.withColumn("_back", F.row_number().over(Window.partitionBy(*at).orderBy(edge_order))).where(F.col("_back") <= rows)
    series = Window.partitionBy(*keys).orderBy(block_order)
    table = core.groupBy(*at).agg(F.count(F.lit(1)).alias("_cnt"))
    table = table.withColumns({"_from": F.lag("_block").over(series), "_start": F.sum("_cnt").over(series.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_cnt")})
    # the blocks that end less than `rows` rows before this one starts, each known to the row of the block that follows it
    near = Window.partitionBy(*keys).orderBy("_start").rangeBetween(-(rows - 1), 0)
    ends = F.collect_list(F.when(F.col("_from").isNotNull(), F.struct(F.col("_from").alias("b"), F.col("_start").alias("e")))).over(near)
    wanted = table.withColumn("_ends", ends).withColumn("_x", F.explode("_ends")).select(
        *[F.col(k).alias(f"{k}h") for k in keys], F.col("_block").alias("_to"), F.col("_x.b").alias("_of"), (rows - F.col("_start") + F.col("_x.e")).alias("_need")
    )
    # null-safe also for the block, which is never null: a plain equality would push a filter below the exchange that `core` shares with others
    joined = edge.join(wanted, same_keys(keys, "h") & F.col("_block").eqNullSafe(F.col("_of")) & (F.col("_back") <= F.col("_need")))
    return joined.withColumn("_block", F.col("_to")).select(*core.columns)
