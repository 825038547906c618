"""Queries of the problems tagged llm (p4, p6 to p8) and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.buckets import log_width
from tidemark.llm import mixing, packing, quantiles, tokens, truncation
from tidemark.session import cut_lineage
from tidemark.sources.tables import table

PERCENTS = [0.0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0]
ERROR = 0.01


# -- p4: percentiles of very large numeric columns

def _fills(spark: SparkSession, base: str, *keep: str) -> DataFrame:
    """Fills with their exit day; a row that was delivered twice is one fill."""
    day = F.substring("exit_ts", 1, 10).alias("exit_day")
    rows = quantiles.once(table(spark, base, "fills"), [c if c != "exit_day" else "exit_ts" for c in keep] + ["pnl"])
    return rows.select(*[day if c == "exit_day" else c for c in keep], "pnl")


def _runs(spark: SparkSession, base: str, by: str) -> DataFrame:
    return quantiles.once(table(spark, base, "run_metrics"), [by, "ending_equity"])


def _read(df: DataFrame, by: str, value: str) -> DataFrame:
    return quantiles.percentiles(quantiles.sketch(df, [by], value, ERROR), [by], PERCENTS, ERROR)


def p4_pnl_by_exit_day(spark: SparkSession, base: str) -> DataFrame:
    return _read(_fills(spark, base, "exit_day"), "exit_day", "pnl")


def p4_pnl_by_symbol(spark: SparkSession, base: str) -> DataFrame:
    """Combined from the sketches of single exit days."""
    days = quantiles.sketch(_fills(spark, base, "symbol", "exit_day"), ["symbol", "exit_day"], "pnl", ERROR)
    return quantiles.percentiles(quantiles.merge_sketches(days, ["symbol"]), ["symbol"], PERCENTS, ERROR)


def p4_pnl_by_side(spark: SparkSession, base: str) -> DataFrame:
    return _read(_fills(spark, base, "side"), "side", "pnl")


def p4_equity_by_symbol(spark: SparkSession, base: str) -> DataFrame:
    return _read(_runs(spark, base, "symbol"), "symbol", "ending_equity")


def p4_equity_by_timeframe(spark: SparkSession, base: str) -> DataFrame:
    return _read(_runs(spark, base, "timeframe"), "timeframe", "ending_equity")


def p4_equity_error(spark: SparkSession, base: str) -> DataFrame:
    """The true percentiles of the runs' equity (a row per run, sorted) and whether the sketch's estimates are within the promised error of them."""
    rows = _runs(spark, base, "timeframe").where(F.col("ending_equity").isNotNull() & ~F.isnan("ending_equity"))
    w = Window.partitionBy("timeframe")
    ranked = rows.select(F.col("timeframe").alias("_t"), "ending_equity", (F.row_number().over(w.orderBy("ending_equity")) - 1).alias("_rank"))
    both = _read(_runs(spark, base, "timeframe"), "timeframe", "ending_equity")
    rank = F.floor(F.col("p") * (F.col("n_values") - 1))
    joined = both.join(ranked, F.col("timeframe").eqNullSafe(F.col("_t")) & (F.col("_rank") == rank))
    near = F.abs(F.col("estimate") - F.col("ending_equity")) <= ERROR * F.abs("ending_equity")
    return joined.select("timeframe", "p", F.col("ending_equity").alias("exact"), near.alias("within_error"))


def _p4_sql(frm: str, by: str, value: str) -> str:
    width = log_width(ERROR)
    scale = 2 * math.exp(width) / (math.exp(width) + 1)
    return f"""
WITH v AS (SELECT {by}, {value} + 0.0::DOUBLE AS x FROM ({frm}) WHERE {value} IS NOT NULL AND NOT isnan({value})),
b AS (
  SELECT {by}, CAST(sign(x) AS INT) AS sgn,
    CASE WHEN isinf(x) THEN 2147483647 WHEN x = 0 THEN 0 ELSE CAST(ceil(ln(abs(x)) / {width!r}::DOUBLE) AS INT) END AS idx,
    count(*) AS n, min(x) AS lo, max(x) AS hi FROM v GROUP BY ALL
), c AS (
  SELECT *, sum(n) OVER (PARTITION BY {by} ORDER BY lo ROWS UNBOUNDED PRECEDING) AS c, sum(n) OVER (PARTITION BY {by}) AS t FROM b
), q AS (SELECT *, unnest([{_PS}]) AS p FROM c)
SELECT {by}, p, CAST(t AS BIGINT) AS n_values, CAST(printf('%.11e', CASE WHEN sgn = 0 THEN 0.0
    WHEN isinf(lo) THEN lo ELSE greatest(lo, least(hi, sgn * exp((idx - 1) * {width!r}::DOUBLE) * {scale!r}::DOUBLE)) END) AS DOUBLE) AS estimate
FROM q WHERE floor(p * (t - 1)) >= c - n AND floor(p * (t - 1)) < c
"""


_PS = ", ".join(f"CAST({p} AS DOUBLE)" for p in PERCENTS)
_FILLS = "SELECT symbol, side, substr(exit_ts, 1, 10) AS exit_day, pnl FROM (SELECT DISTINCT * FROM fills)"
_RUNS = "SELECT DISTINCT * FROM run_metrics"


def _sizes(spark: SparkSession, base: str) -> DataFrame:
    return tokens.with_token_counts(table(spark, base, "documents").select("doc_id", "source", "text")).drop("text")


# -- p6: filling containers

def _capacities(spark: SparkSession, base: str) -> dict[str, int]:
    """pack_sizes is a fixed table of four rows."""
    rows = table(spark, base, "pack_sizes").where("pack_id IS NOT NULL AND capacity_tokens > 0").collect()
    return {r["pack_id"]: r["capacity_tokens"] for r in rows}


def p6_placements(spark: SparkSession, base: str) -> DataFrame:
    return packing.pack(_sizes(spark, base), _capacities(spark, base))


def p6_report(spark: SparkSession, base: str) -> DataFrame:
    return packing.packing_report(p6_placements(spark, base), _capacities(spark, base))


# -- p7: mixing sources

def _mix(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(cut_lineage(_sizes(spark, base)), table(spark, base, "mix_targets"))


def p7_copies(spark: SparkSession, base: str) -> DataFrame:
    return _mix(spark, base)[0]


def p7_shares(spark: SparkSession, base: str) -> DataFrame:
    return _mix(spark, base)[1]


# -- p8: texts cut off

def _cut(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    return truncation.truncated(table(spark, base, "documents"))


def p8_found(spark: SparkSession, base: str) -> DataFrame:
    return _cut(spark, base)[0].where("p_cut > 0.5").select("doc_id")


def p8_by_source(spark: SparkSession, base: str) -> DataFrame:
    return truncation.truncation_report(_cut(spark, base)[0])


def p8_limits(spark: SparkSession, base: str) -> DataFrame:
    return _cut(spark, base)[1]


QUERIES = {f.__name__: f for f in (
    p4_pnl_by_exit_day, p4_pnl_by_symbol, p4_pnl_by_side, p4_equity_by_symbol, p4_equity_by_timeframe, p4_equity_error,
    p6_placements, p6_report, p7_copies, p7_shares, p8_found, p8_by_source, p8_limits,
)}
#: Packing, rounding and the judgement of endings have no SQL; they are tested against brute force, for what they keep, and on held-out texts.
SQL: dict[str, str] = {
    "p4_pnl_by_exit_day": _p4_sql(_FILLS, "exit_day", "pnl"),
    "p4_pnl_by_symbol": _p4_sql(_FILLS, "symbol", "pnl"),
    "p4_pnl_by_side": _p4_sql(_FILLS, "side", "pnl"),
    "p4_equity_by_symbol": _p4_sql(_RUNS, "symbol", "ending_equity"),
    "p4_equity_by_timeframe": _p4_sql(_RUNS, "timeframe", "ending_equity"),
    "p4_equity_error": f"""SELECT timeframe, p, ending_equity AS exact, TRUE AS within_error FROM (
      SELECT *, row_number() OVER (PARTITION BY timeframe ORDER BY ending_equity) - 1 AS r, count(*) OVER (PARTITION BY timeframe) AS n, unnest([{_PS}]) AS p
      FROM ({_RUNS}) WHERE ending_equity IS NOT NULL AND NOT isnan(ending_equity)) WHERE r = floor(p * (n - 1))""",
}
