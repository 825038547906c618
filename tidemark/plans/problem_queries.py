"""Queries of the general data-preparation problems (p1, p2, p3, p5) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import drift, outliers, regrid, snapshots
from tidemark.sources.tables import table


# -- p1: what changed between full snapshots

def p1_changes(spark: SparkSession, base: str) -> DataFrame:
    return snapshots.snapshot_changes(table(spark, base, "snapshot_bars"), table(spark, base, "snapshot_meta"))


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    return p1_changes(spark, base).select("snapshot_id", F.unix_seconds("time").alias("bar_epoch"), "change_kind")


def p1_summary(spark: SparkSession, base: str) -> DataFrame:
    return snapshots.change_summary(p1_changes(spark, base))


P1_SQL = """
WITH m AS (
  SELECT DISTINCT upper(trim(broker)) AS b, upper(trim(symbol)) AS s, snapshot_id FROM snapshot_meta WHERE snapshot_id IS NOT NULL
), i AS (
  SELECT *, lead(snapshot_id) OVER w AS nxt, lag(snapshot_id) OVER w AS prv FROM m WINDOW w AS (PARTITION BY b, s ORDER BY snapshot_id)
), r AS (
  SELECT snapshot_id, time, max(CASE WHEN isnan(close) THEN NULL ELSE close END) AS v
  FROM snapshot_bars WHERE time IS NOT NULL GROUP BY snapshot_id, time
), c AS (SELECT i.b, i.s, r.*, i.prv, i.nxt FROM r JOIN i USING (snapshot_id)),
x AS (
  SELECT c.snapshot_id, c.time, CASE WHEN p.time IS NULL THEN 'added' ELSE 'changed' END AS change_kind
  FROM c LEFT JOIN r p ON p.snapshot_id = c.prv AND p.time = c.time
  WHERE c.prv IS NOT NULL AND (p.time IS NULL OR (c.v IS NULL) <> (p.v IS NULL) OR abs(c.v - p.v) > 0.000001)
  UNION ALL
  SELECT c.nxt, c.time, 'removed' FROM c LEFT JOIN r n ON n.snapshot_id = c.nxt AND n.time = c.time
  WHERE c.nxt IS NOT NULL AND n.time IS NULL
)
"""


# -- p2: schemas that drift between files

TRACKED = {"bars_csv": ["tick_volume", "real_volume"], "metrics_json": ["git_commit", "n_trades"]}
TARGETS = {"bars_csv": drift.BARS_TARGET, "metrics_json": drift.METRICS_TARGET}


def p2_changes(spark: SparkSession, base: str) -> DataFrame:
    schemas = drift.file_schemas(drift.parse_lines(table(spark, base, "raw_records"), once=False))
    return drift.schema_changes(drift.match_files(schemas, TARGETS), TRACKED)


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    return p2_changes(spark, base).select("stream_id", "file_name", "field", "change_kind")


def _p2_table(spark: SparkSession, base: str, kind: str, columns: dict[str, str]) -> DataFrame:
    parsed = drift.parse_lines(table(spark, base, "raw_records"))
    return drift.unify(parsed, drift.match_files(drift.file_schemas(parsed), TARGETS), kind, columns)


def p2_bars(spark: SparkSession, base: str) -> DataFrame:
    """All bar files as one table; fields of none of its columns are in `other`."""
    prices = dict.fromkeys(("open", "high", "low", "close"), "double")
    return _p2_table(spark, base, "bars_csv", {"time": "timestamp", **prices, "tick_volume": "bigint", "spread": "bigint", "real_volume": "bigint"})


def p2_metrics(spark: SparkSession, base: str) -> DataFrame:
    """All metrics files as one table; fields of none of its columns are in `other`."""
    return _p2_table(spark, base, "metrics_json", {
        "run_id": "string", "symbol": "string", "timeframe": "string", "n_bars": "bigint", "start_ts": "string", "end_ts": "string", "starting_capital": "double",
        "ending_equity": "double", "n_trades": "bigint", "total_pnl": "double", "win_rate": "double", "average_win": "double", "average_loss": "double",
        "max_drawdown_pct": "double", "risk_halted": "boolean", "risk_halted_at": "string", "daily_drawdown_pct_limit": "double",
        "monthly_drawdown_pct_limit": "double", "daily_halts": "bigint", "monthly_halts": "bigint", "git_commit": "string", "git_dirty": "boolean",
    })


# An independent way to the same changes: the spellings are listed, as SQL can't match them.
_SPELLED = {
    "bars_csv": {"tick_volume": "tickvolume tickvol nticks volticks", "real_volume": "realvolume realvol volumereal tradedvolume"},
    "metrics_json": {
        "git_commit": "git_commit gitCommit git_sha commit commit_sha build.git_commit git.commit vcs.revision",
        "n_trades": "n_trades nTrades N_TRADES num_trades trade_count trades stats.n_trades trades.count",
    },
}
_CSV_FIELD = "CASE " + " ".join(f"WHEN k IN ({', '.join(repr(n) for n in names.split())}) THEN '{f}'" for f, names in _SPELLED["bars_csv"].items()) + " END"
_JSON_PATHS = ", ".join(f"('{f}', '{n}', '$.{n}')" for f, names in _SPELLED["metrics_json"].items() for n in names.split())
_COUNTS = ", ".join(f"len(h) - len(replace(h, {d}, '')) AS c{i}" for i, d in enumerate(("','", "';'", "chr(9)", "'|'")))
P2_SQL = rf"""
WITH l AS (SELECT stream_id, file_name, kind, line_no, min(file_date) AS d, max(line_text) AS t FROM raw_records GROUP BY ALL),
f AS (SELECT stream_id, kind, file_name, min(d) AS d FROM l GROUP BY ALL),
h AS (SELECT stream_id, file_name, ltrim(t, chr(65279)) AS h FROM l WHERE kind = 'bars_csv' AND line_no = 1),
e AS (SELECT *, CASE greatest(c0, c1, c2, c3) WHEN c0 THEN ',' WHEN c1 THEN ';' WHEN c2 THEN chr(9) ELSE '|' END AS e FROM (SELECT *, {_COUNTS} FROM h)),
c AS (SELECT stream_id, file_name, e, unnest(string_split(h, e)) AS n, generate_subscripts(string_split(h, e), 1) AS pos FROM e),
cf AS (SELECT *, {_CSV_FIELD} AS field FROM (SELECT stream_id, file_name, e, pos, trim(n, ' "' || chr(39)) AS name, lower(regexp_replace(n, '[^A-Za-z]', '', 'g')) AS k FROM c)),
cv AS (SELECT cf.stream_id, cf.file_name, cf.field, cf.name, trim(string_split(regexp_replace(l.t, '"([^"]*),([^"]*)"', '"\1_\2"', 'g'), cf.e)[cf.pos], ' "') AS v
  FROM cf LEFT JOIN l ON l.stream_id = cf.stream_id AND l.file_name = cf.file_name AND l.line_no > 1 AND l.kind = 'bars_csv' WHERE cf.field IS NOT NULL),
ck AS (SELECT stream_id, file_name, field, name, CASE WHEN v IS NULL OR lower(v) IN ('', 'null', 'na', 'nan') THEN NULL WHEN regexp_full_match(v, '[+-]?\d+') THEN 0
  WHEN regexp_full_match(v, '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?') THEN 1 ELSE 2 END AS k FROM cv),
j AS (SELECT stream_id, file_name, CAST(t AS JSON) AS t FROM l WHERE kind = 'metrics_json' AND json_valid(t)),
jk AS (SELECT stream_id, file_name, field, name, CASE json_type(t, path) WHEN 'ARRAY' THEN 3 WHEN 'DOUBLE' THEN 1 WHEN 'BOOLEAN' THEN 2 WHEN 'NULL' THEN NULL
  WHEN 'VARCHAR' THEN CASE WHEN lower(trim(json_extract_string(t, path))) NOT IN ('', 'null', 'na', 'nan') THEN 2 END ELSE 0 END AS k
  FROM j, (VALUES {_JSON_PATHS}) AS p(field, name, path) WHERE json_exists(t, path) AND json_type(t, path) <> 'OBJECT'),
m AS (SELECT stream_id, file_name, field, max(name) AS name, max(k) AS k FROM (SELECT * FROM ck UNION ALL SELECT * FROM jk) GROUP BY ALL),
s AS (SELECT f.stream_id, f.file_name, p.field, f.d, m.name, m.k FROM f
  JOIN (VALUES ('bars_csv', 'tick_volume'), ('bars_csv', 'real_volume'), ('metrics_json', 'git_commit'), ('metrics_json', 'n_trades')) AS p(kind, field) ON p.kind = f.kind
  LEFT JOIN m ON m.stream_id = f.stream_id AND m.file_name = f.file_name AND m.field = p.field),
w AS (SELECT *, row_number() OVER w AS n, lag(name) OVER w AS before, last_value(k IGNORE NULLS) OVER (PARTITION BY stream_id, field ORDER BY d, file_name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS told
  FROM s WINDOW w AS (PARTITION BY stream_id, field ORDER BY d, file_name))
SELECT stream_id, file_name, field, 'added' AS change_kind FROM w WHERE n > 1 AND before IS NULL AND name IS NOT NULL
UNION ALL SELECT stream_id, file_name, field, 'removed' FROM w WHERE n > 1 AND before IS NOT NULL AND name IS NULL
UNION ALL SELECT stream_id, file_name, field, 'renamed' FROM w WHERE n > 1 AND before <> name
UNION ALL SELECT stream_id, file_name, field, 'type_changed' FROM w WHERE n > 1 AND told <> k
"""


# -- p3: irregular readings onto a regular grid

def p3_grid(spark: SparkSession, base: str) -> DataFrame:
    grid = regrid.regrid(table(spark, base, "bars"))
    return grid.select("broker", "symbol", "slot_epoch", "value", "status", "n_readings")


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return regrid.empty_slots(regrid.regrid(table(spark, base, "bars"))).select("broker", "symbol", "slot_epoch")


P3_SQL = """
WITH r AS (
  SELECT broker, symbol, epoch_us(time) AS t, close AS v, epoch_us(arrived_utc) AS a, CAST(floor(epoch_us(time) / 300000000.0) AS BIGINT) AS slot
  FROM bars WHERE close IS NOT NULL AND NOT isnan(close) AND time IS NOT NULL
), s AS (
  SELECT broker, symbol, slot, count(*) AS n, arg_max(t, (t, a, v)) AS lt, arg_max(v, (t, a, v)) AS lv,
         arg_min(t, (t, -a, -v)) AS ft, arg_min(v, (t, -a, -v)) AS fv
  FROM r GROUP BY ALL
), e AS (
  SELECT *, lead(slot) OVER w AS ns, lead(ft) OVER w AS nt, lead(fv) OVER w AS nv
  FROM s WINDOW w AS (PARTITION BY broker, symbol ORDER BY slot)
), g AS (SELECT *, unnest(range(slot, coalesce(ns, slot + 1))) AS k FROM e)
SELECT broker, symbol, k * 300 AS slot_epoch,
  CASE WHEN k = slot THEN lv WHEN nt - lt <= 3600000000 THEN lv + (nv - lv) * ((k * 300000000 - lt) / (nt - lt)::DOUBLE) END AS value,
  CASE WHEN k = slot THEN 'observed' WHEN nt - lt <= 3600000000 THEN 'filled' ELSE 'missing' END AS status,
  CASE WHEN k = slot THEN n ELSE 0 END AS n_readings
FROM g
"""


# -- p5: implausible spikes, stuck and impossible values

def p5_found(spark: SparkSession, base: str) -> DataFrame:
    found = outliers.implausible(table(spark, base, "bars"))
    return found.select("broker", "symbol", F.unix_millis("time").alias("time_ms"))


def p5_impossible(spark: SparkSession, base: str) -> DataFrame:
    """The bars that no market could show, which needs no comparison with others."""
    found = outliers.impossible(table(spark, base, "bars"))
    return found.select("broker", "symbol", F.unix_millis("time").alias("time_ms"))


def p5_stuck(spark: SparkSession, base: str) -> DataFrame:
    found = outliers.implausible(table(spark, base, "bars")).where("stuck")
    return found.select("broker", "symbol", F.unix_millis("time").alias("time_ms"))


_P5_ONCE = """
WITH o AS (
  SELECT * FROM (SELECT * REPLACE (CASE WHEN isnan(high) THEN NULL ELSE high END AS high, CASE WHEN isnan(low) THEN NULL ELSE low END AS low, CASE WHEN isnan(close) THEN NULL ELSE close END AS close) FROM bars)
  WHERE time IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY broker, symbol, time ORDER BY arrived_utc DESC NULLS LAST, high DESC NULLS LAST, low DESC NULLS LAST, close DESC NULLS LAST, spread DESC NULLS LAST) = 1
)"""

P5_IMPOSSIBLE_SQL = _P5_ONCE + """
SELECT broker, symbol, CAST(floor(epoch_us(time) / 1000.0) AS BIGINT) AS time_ms FROM o
WHERE coalesce(high < low, FALSE) OR coalesce(close > high, FALSE) OR coalesce(close < low, FALSE) OR coalesce(spread < 0, FALSE)
  OR coalesce(high <= 0, FALSE) OR coalesce(low <= 0, FALSE) OR coalesce(close <= 0, FALSE) OR coalesce(greatest(high, low, close) >= 5000000.0, FALSE)
"""

P5_STUCK_SQL = _P5_ONCE + """,
s AS (SELECT broker, symbol, time, CASE WHEN high = lag(high) OVER w AND low = lag(low) OVER w AND close = lag(close) OVER w THEN 0 ELSE 1 END AS fresh
  FROM o WHERE high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL WINDOW w AS (PARTITION BY broker, symbol ORDER BY time)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY broker, symbol ORDER BY time ROWS UNBOUNDED PRECEDING) AS run FROM s),
c AS (SELECT broker, symbol, run, count(*) - 1 AS n FROM r GROUP BY ALL),
t AS (SELECT broker, symbol, count(*) AS f, count(*) FILTER (n > 0) AS k, count(*) FILTER (n = 1) AS n1, count(*) FILTER (n = 2) AS n2, count(*) FILTER (n = 3) AS n3 FROM c GROUP BY ALL),
l AS (SELECT broker, symbol, greatest(5, 1 + ceil(ln(greatest(k, 1) / 0.001::DOUBLE) / -ln(least(greatest(k / f::DOUBLE, (n2 + n3 + 0.1::DOUBLE) / (n1 + n2 + 2.0::DOUBLE)), 1 - 1 / (k + 2.0::DOUBLE))))) AS least FROM t)
SELECT r.broker, r.symbol, CAST(floor(epoch_us(r.time) / 1000.0) AS BIGINT) AS time_ms
FROM r JOIN c ON c.broker IS NOT DISTINCT FROM r.broker AND c.symbol IS NOT DISTINCT FROM r.symbol AND c.run = r.run
JOIN l ON l.broker IS NOT DISTINCT FROM r.broker AND l.symbol IS NOT DISTINCT FROM r.symbol WHERE r.fresh = 0 AND c.n >= l.least
"""


def p5_by_source(spark: SparkSession, base: str) -> DataFrame:
    """Number of affected bars of each series, by kind."""
    found = outliers.implausible(table(spark, base, "bars"))
    return found.groupBy("broker", "symbol").agg(*[F.count_if(k).alias(f"n_{k}") for k in ("impossible", "spike", "stuck")])


QUERIES = {
    "p1_found": p1_found, "p1_summary": p1_summary,
    "p2_found": p2_found, "p2_bars": p2_bars, "p2_metrics": p2_metrics,
    "p3_found": p3_found, "p3_grid": p3_grid,
    "p5_found": p5_found, "p5_impossible": p5_impossible, "p5_stuck": p5_stuck, "p5_by_source": p5_by_source,
}

SQL = {
    "p2_found": P2_SQL,
    "p1_found": P1_SQL + "SELECT snapshot_id, CAST(floor(epoch(time)) AS BIGINT) AS bar_epoch, change_kind FROM x",
    "p1_summary": P1_SQL + "SELECT snapshot_id, change_kind, count(*) AS n_changes FROM x GROUP BY ALL",
    "p3_found": f"SELECT broker, symbol, slot_epoch FROM ({P3_SQL}) WHERE status <> 'observed'",
    "p3_grid": P3_SQL,
    "p5_impossible": P5_IMPOSSIBLE_SQL, "p5_stuck": P5_STUCK_SQL,
}
