"""Queries of the bar engine and their SQL: derivation, validation, features, signals, execution, limits, metrics, expectancy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.cols import round_sig
from tidemark.operators import backtest, expectancy, features, strategy, validate
from tidemark.operators.features import ADX, EMA, SMA, Diff, FeaturePipeline, FeatureSpec, Frame, Lag, Rescale, ZScore
from tidemark.schema import coalesce_volume, missing_as_null
from tidemark.sources import snapshot
from tidemark.sources.tables import table

HOURLY = Frame(("symbol",))
SERIES = Frame(("broker", "symbol"))
CAPITAL, LIMIT, DAILY, MONTHLY = 1000.0, 25.0, 8.0, 60.0
FAST, SLOW, ADX_N, ADX_LEVEL = 3, 8, 5, 30.0
DIGITS = 9


# -- bars

def hourly(spark: SparkSession, base: str) -> DataFrame:
    """Hourly bars of event values, a series for each type of event."""
    at = F.struct("ts", "event_id")
    return table(spark, base, "events").groupBy(
        F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("time")
    ).agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count(F.lit(1)).alias("volume"))


def market(spark: SparkSession, base: str) -> DataFrame:
    """The bars table, each time of a series once: the latest arrival, without bars that lack a price."""
    raw = missing_as_null(table(spark, base, "bars"))
    w = Window.partitionBy("broker", "symbol", "time").orderBy(F.desc("arrived_utc"), *[F.desc_nulls_last(c) for c in ("close", "high", "low", "open")])
    once = raw.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "arrived_utc")
    return coalesce_volume(once.dropna(subset=list(validate.PRICES))).withColumn("time", F.col("time").cast("timestamp_ntz"))


_HOURLY = """SELECT event_type AS symbol, date_trunc('hour', ts) AS time, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, (ts, event_id)) AS close, count(*) AS volume FROM events GROUP BY ALL"""
_MARKET = """SELECT * EXCLUDE (arrived_utc) REPLACE (CAST(time AT TIME ZONE 'UTC' AS TIMESTAMP) AS time), tick_volume AS volume FROM bars
  WHERE TRUE QUALIFY row_number() OVER (PARTITION BY broker, symbol, time ORDER BY arrived_utc DESC, close DESC NULLS LAST, high DESC NULLS LAST, low DESC NULLS LAST, open DESC NULLS LAST) = 1"""
_MARKET = f"SELECT * FROM ({_MARKET}) WHERE open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL"


def bars_hourly(spark, base):
    return hourly(spark, base)


def market_bars(spark, base):
    return market(spark, base).select("broker", "symbol", "time", "open", "high", "low", "close", "volume")


# -- validation, snapshots

def validate_counts(spark, base):
    raw = table(spark, base, "bars").withColumn(validate.ARRIVAL, F.struct("arrived_utc", "time"))
    return validate.validation_counts(raw, ["broker", "symbol"])


_VALIDATE = """
WITH o AS (SELECT *, lag(time) OVER (PARTITION BY broker, symbol ORDER BY arrived_utc, time) > time AS late FROM bars)
SELECT broker, symbol, count(*) AS n_rows, count(*) FILTER (time IS NULL) AS null_times, count(time) - count(DISTINCT time) AS duplicate_times,
  count(*) FILTER (late) AS out_of_order, """ + ", ".join(
    f"count(*) FILTER ({c} IS NULL OR isnan({c})) AS missing_{c}" for c in validate.PRICES) + ", count(*) FILTER (spread < 0) AS negative_spreads FROM o GROUP BY ALL"


def dedupe_first_wins(spark, base):
    """Bars of two deliveries, split by month of arrival: what was there first holds."""
    raw = table(spark, base, "bars").select("broker", "symbol", "time", "close", "arrived_utc")
    late = F.month(F.to_utc_timestamp("arrived_utc", F.current_timezone())) % 2 == 0
    order = F.struct(F.col("arrived_utc"), F.coalesce("close", F.lit(-1.0)))
    rows = raw.withColumn(validate.ARRIVAL, order)
    out = validate.first_wins(rows.where(~late), rows.where(late), ["broker", "symbol", "time"])
    return out.select("broker", "symbol", F.unix_seconds("time").alias("epoch"), "close")


_FIRST_WINS = """SELECT broker, symbol, CAST(floor(epoch(time)) AS BIGINT) AS epoch, close FROM bars
QUALIFY row_number() OVER (PARTITION BY broker, symbol, time ORDER BY month(arrived_utc AT TIME ZONE 'UTC') % 2 = 0, arrived_utc, coalesce(close, -1.0)) = 1"""


def yearly_split_counts(spark, base):
    """Bars in each of the files that the yearly writer would write."""
    return snapshot.year_counts(table(spark, base, "bars"), ["broker", "symbol"])


def snapshot_meta(spark, base):
    return snapshot.ranges(table(spark, base, "snapshot_bars"), ["snapshot_id"])


# -- features

FEATURES = [
    FeatureSpec(SMA(10)), FeatureSpec(SMA(200)), FeatureSpec(SMA(5), (Diff(1),)), FeatureSpec(SMA(5), (Lag(3),)), FeatureSpec(SMA(20, "volume")),
    FeatureSpec(SMA(10), (Rescale(0, 1000), Diff(2)), alias="slope"),
]


def _rounded(df, keys, names, **places):
    """Averages to 12 significant digits; others to decimal places, as differences of large numbers have few good digits."""
    return df.select(*keys, *[(F.round(n, places[n]) if n in places else round_sig(F.col(n), 12)).alias(n) for n in names])


def _sig(x, places=11):
    return f"CASE WHEN {x} IS NOT NULL THEN CAST(printf('%.{places}e', CAST({x} AS DOUBLE)) AS DOUBLE) END"


def _sql_sma(n, source, keys):
    w = f"PARTITION BY {keys} ORDER BY time"
    d = f"CAST({source} AS DECIMAL(30,12))"
    frame = f"({w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({source}) OVER {frame} = {n} THEN CAST(sum({d}) OVER {frame} AS DOUBLE) / {n} END"


def _market_features(spark, base, pipe):
    """Series of any length in blocks."""
    return pipe.features(market(spark, base), split=True, sizes=table(spark, base, "bars"))


def sma(spark, base):
    """Averages over 10 and 200 bars of every series."""
    pipe = FeaturePipeline(FEATURES[:2], SERIES.keys)
    return _rounded(_market_features(spark, base, pipe), ["broker", "symbol", "time"], pipe.names())


def ema(spark, base):
    pipe = FeaturePipeline([FeatureSpec(EMA(10)), FeatureSpec(EMA(30))], HOURLY.keys)
    return _rounded(pipe.features(hourly(spark, base)), ["symbol", "time"], pipe.names(), ema_10_close=8, ema_30_close=8)


def diff(spark, base):
    pipe = FeaturePipeline([FEATURES[2]], SERIES.keys)
    return _rounded(_market_features(spark, base, pipe), ["broker", "symbol", "time"], pipe.names(), sma_5_close_diff_1=6)


def lag(spark, base):
    pipe = FeaturePipeline([FEATURES[3]], SERIES.keys)
    return _rounded(_market_features(spark, base, pipe), ["broker", "symbol", "time"], pipe.names())


def rescale(spark, base):
    pipe = FeaturePipeline([FeatureSpec(SMA(5), (Rescale(0, 200, -1, 1),), alias="rescaled")], HOURLY.keys)
    return _rounded(pipe.features(hourly(spark, base)), ["symbol", "time"], pipe.names())


def zscore(spark, base):
    pipe = FeaturePipeline([FeatureSpec(SMA(1), (ZScore(20),), alias="z")], HOURLY.keys)
    return pipe.features(hourly(spark, base)).select("symbol", "time", F.round("z", 6).alias("z"))


def feature_pipeline(spark, base):
    """Several averages with transforms from one shuffle and sort."""
    pipe = FeaturePipeline(FEATURES, SERIES.keys)
    return _rounded(_market_features(spark, base, pipe), ["broker", "symbol", "time"], pipe.names(), sma_5_close_diff_1=6, slope=9)


def true_range_dm(spark, base):
    up, down = features.directional_moves(HOURLY)
    return hourly(spark, base).select("symbol", "time", features.true_range(HOURLY).alias("true_range"), up.alias("plus_dm"), down.alias("minus_dm"))


def adx(spark, base):
    pipe = FeaturePipeline([FeatureSpec(ADX(ADX_N))], HOURLY.keys)
    return _rounded(pipe.features(hourly(spark, base)), ["symbol", "time"], pipe.names(), **{f"adx_{ADX_N}": 8})


_B = "broker, symbol"
_SMA5 = f"WITH s AS (SELECT *, {_sql_sma(5, 'close', _B)} AS v FROM ({_MARKET}))"
_KEYED = "PARTITION BY broker, symbol ORDER BY time"
_PIPE = f"""WITH s AS (SELECT *, {_sql_sma(5, 'close', _B)} AS a5, {_sql_sma(10, 'close', _B)} AS a10, {_sql_sma(200, 'close', _B)} AS a200,
  {_sql_sma(20, 'volume', _B)} AS v20 FROM ({_MARKET}))
SELECT broker, symbol, time, {_sig('a10')} AS sma_10_close, {_sig('a200')} AS sma_200_close, round(a5 - lag(a5) OVER ({_KEYED}), 6) AS sma_5_close_diff_1,
  {_sig(f'lag(a5, 3) OVER ({_KEYED})')} AS sma_5_close_lag_3, {_sig('v20')} AS sma_20_volume,
  round(a10 / 1000.0::DOUBLE - lag(a10 / 1000.0::DOUBLE, 2) OVER ({_KEYED}), 9) AS slope FROM s"""

_NUMBERED = f"SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time) - 1 AS i FROM ({_HOURLY})"


_NUMBERED_MARKET = f"SELECT * EXCLUDE (broker) REPLACE (broker || '/' || symbol AS symbol), row_number() OVER (PARTITION BY broker, symbol ORDER BY time) - 1 AS i FROM ({_MARKET})"


def _ema_sql(n):
    a = 2.0 / (n + 1)
    return f"""e{n} AS (SELECT symbol, i, close AS v FROM b WHERE i = 0
  UNION ALL SELECT b.symbol, b.i, {1 - a!r}::DOUBLE * e.v + {a!r}::DOUBLE * b.close FROM e{n} e JOIN b ON b.symbol = e.symbol AND b.i = e.i + 1)"""


_EMA = f"""WITH RECURSIVE b AS MATERIALIZED ({_NUMBERED}), {_ema_sql(10)}, {_ema_sql(30)}
SELECT symbol, time, CASE WHEN i >= 9 THEN round(x.v, 8) END AS ema_10_close, CASE WHEN i >= 29 THEN round(y.v, 8) END AS ema_30_close
FROM b JOIN e10 x USING (symbol, i) JOIN e30 y USING (symbol, i)"""

def _moves(numbered):
    return f"""SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr,
  CASE WHEN pc IS NOT NULL THEN CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0.0 END END AS pdm,
  CASE WHEN pc IS NOT NULL THEN CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0.0 END END AS mdm
FROM (SELECT *, lag(close) OVER w AS pc, lag(high) OVER w AS ph, lag(low) OVER w AS pl FROM ({numbered}) WINDOW w AS (PARTITION BY symbol ORDER BY time))"""


_MOVES = _moves(_NUMBERED)

_P = ADX_N


def _adx_cte(moves):
    return f"""m AS MATERIALIZED ({moves}),
seed AS (SELECT symbol, sum(tr ORDER BY i) AS t, sum(pdm ORDER BY i) AS p, sum(mdm ORDER BY i) AS q FROM m WHERE i BETWEEN 1 AND {_P} GROUP BY symbol HAVING count(*) = {_P}),
s AS (SELECT symbol, {_P} AS i, t, p, q FROM seed
  UNION ALL SELECT m.symbol, m.i, s.t - s.t / {_P} + m.tr, s.p - s.p / {_P} + m.pdm, s.q - s.q / {_P} + m.mdm FROM s JOIN m ON m.symbol = s.symbol AND m.i = s.i + 1),
d AS MATERIALIZED (SELECT symbol, i, CASE WHEN t = 0 THEN NULL WHEN p + q = 0 THEN 0 ELSE 100 * abs(100 * p / t - 100 * q / t) / (100 * p / t + 100 * q / t) END AS dx FROM s),
a AS (SELECT symbol, {2 * _P} AS i, CASE WHEN count(dx) = {_P} THEN avg(dx) END AS v FROM d WHERE i BETWEEN {_P + 1} AND {2 * _P} GROUP BY symbol HAVING count(*) = {_P}
  UNION ALL SELECT d.symbol, d.i, (a.v * {_P - 1} + d.dx) / {_P} FROM a JOIN d ON d.symbol = a.symbol AND d.i = a.i + 1)"""


_ADX_CTE = _adx_cte(_MOVES)
_ADX = f"WITH RECURSIVE {_ADX_CTE} SELECT m.symbol, m.time, round(a.v, 8) AS adx_{_P} FROM m LEFT JOIN a USING (symbol, i)"


# -- signals and execution

def _signals(spark, base, filtered=False):
    options = {"type": "ma_crossover", "fast_period": FAST, "slow_period": SLOW, "digits": DIGITS}
    if filtered:
        options |= {"type": "adx_filtered", "adx_period": ADX_N, "adx_threshold": ADX_LEVEL}
    made, specs = strategy.build_strategy(options)
    return strategy.with_signal(FeaturePipeline(specs, HOURLY.keys).transform(hourly(spark, base)), made, HOURLY)


def signal_ma(spark, base):
    return _signals(spark, base).select("symbol", "time", "direction", "strength", "reason")


def signal_adx(spark, base):
    return _signals(spark, base, True).select("symbol", "time", "direction", "strength", "reason")


def _curve(spark, base, risk=backtest.RiskConfig()):
    return backtest.run(_signals(spark, base), HOURLY, CAPITAL, 1.0, risk)


def _six(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def positions(spark, base):
    return _curve(spark, base).select("symbol", "time", "position")


def trades(spark, base):
    return _six(backtest.trades(_curve(spark, base), HOURLY), "pnl")


def equity_curve(spark, base):
    return _six(backtest.equity_records(_curve(spark, base), HOURLY), "equity", "unrealized_pnl", "realized_pnl")


def resized_positions(spark, base):
    """Wanted positions of sizes one to three by turns: only changes of sign trade."""
    sized = _signals(spark, base).withColumn("_n", F.row_number().over(HOURLY.ordered)).withColumn("direction", F.col("direction") * (1 + F.col("_n") % 3))
    return _six(backtest.run(sized, HOURLY, CAPITAL, 0.5).select("symbol", "time", "position", "fill_pnl", "equity"), "fill_pnl", "equity")


def drawdown(spark, base):
    return _six(_curve(spark, base).select("symbol", "time", "peak_equity", "drawdown_pct", "max_drawdown_pct"), "peak_equity", "drawdown_pct", "max_drawdown_pct")


def global_halt(spark, base):
    curve = _curve(spark, base, backtest.RiskConfig(LIMIT))
    return _six(curve.select("symbol", "time", "position", "equity", "halted", "risk_reason"), "equity")


def period_pause(spark, base):
    curve = _curve(spark, base, backtest.RiskConfig(LIMIT, DAILY, MONTHLY))
    return _six(curve.select("symbol", "time", "position", "equity", "max_drawdown_pct", "halted", "flatten", "daily_halts", "monthly_halts", "risk_reason"), "equity", "max_drawdown_pct")


def metrics(spark, base):
    risk = backtest.RiskConfig(LIMIT)
    found = backtest.metrics(_curve(spark, base, risk), HOURLY, CAPITAL, risk)
    return _six(found, "ending_equity", "total_pnl", "win_rate", "average_win", "average_loss", "max_drawdown_pct")


def _signal_cte(bars, fast, slow):
    return f"""b AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time) - 1 AS i FROM ({bars})),
avgs AS (SELECT *, round({_sql_sma(fast, 'close', 'symbol')}, {DIGITS}) AS f, round({_sql_sma(slow, 'close', 'symbol')}, {DIGITS}) AS g FROM b),
sig AS MATERIALIZED (SELECT *, CASE WHEN i < {slow} OR f IS NULL OR g IS NULL THEN 0.0::DOUBLE WHEN f > g THEN 1.0::DOUBLE WHEN f < g THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS direction,
  CASE WHEN i < {slow} OR f IS NULL OR g IS NULL THEN '{strategy.WARMUP}' WHEN f > g THEN 'cross_above' WHEN f < g THEN 'cross_below' ELSE 'equal' END AS reason FROM avgs)"""


_SIGNAL_CTE = _signal_cte(_HOURLY, FAST, SLOW)


def market_backtest(spark, base):
    """The crossover of 10 and 30 bars on every series of the bars table, with a global limit: metrics by series."""
    made, specs = strategy.build_strategy({"type": "ma_crossover", "fast_period": 10, "slow_period": 30, "digits": DIGITS})
    bars = market(spark, base).withColumn("symbol", F.concat_ws("/", "broker", "symbol")).drop("broker")
    risk = backtest.RiskConfig(LIMIT)
    signals = strategy.with_signal(FeaturePipeline(specs, HOURLY.keys).transform(bars), made, HOURLY)
    found = backtest.metrics(backtest.run(signals, HOURLY, 100_000.0, 1.0, risk), HOURLY, 100_000.0, risk)
    return found.select("symbol", "n_bars", "n_trades", F.round("total_pnl", 4).alias("total_pnl"), F.round("ending_equity", 4).alias("ending_equity"), "risk_halted")


# -- recurrences and limits by period on the bars table; too slow in SQL there

def _market_run(spark, base, risk=None):
    options = {"type": "adx_filtered", "fast_period": FAST, "slow_period": SLOW, "digits": DIGITS, "adx_period": ADX_N, "adx_threshold": ADX_LEVEL}
    made, specs = strategy.build_strategy(options)
    signals = strategy.with_signal(FeaturePipeline(specs, SERIES.keys).transform(market(spark, base)), made, SERIES)
    return signals if risk is None else backtest.run(signals, SERIES, 100_000.0, 1.0, risk)


def market_ema(spark, base):
    pipe = FeaturePipeline([FeatureSpec(EMA(10)), FeatureSpec(EMA(30))], SERIES.keys)
    return _market_features(spark, base, pipe).select("broker", "symbol", "time", *[round_sig(F.col(n), 8).alias(n) for n in pipe.names()])


def market_adx(spark, base):
    pipe = FeaturePipeline([FeatureSpec(ADX(ADX_N))], SERIES.keys)
    return _rounded(_market_features(spark, base, pipe), ["broker", "symbol", "time"], pipe.names(), **{f"adx_{ADX_N}": 5})


def market_signal_adx(spark, base):
    return _market_run(spark, base).select("broker", "symbol", "time", "direction", "strength", "reason")


def market_period_pause(spark, base):
    curve = _market_run(spark, base, backtest.RiskConfig(LIMIT, DAILY, MONTHLY))
    names = ("position", "equity", "max_drawdown_pct", "halted", "flatten", "daily_halts", "monthly_halts")
    return _six(curve.select("broker", "symbol", "time", *names), "equity", "max_drawdown_pct")


def market_metrics(spark, base):
    risk = backtest.RiskConfig(LIMIT, DAILY, MONTHLY)
    found = backtest.metrics(_market_run(spark, base, risk), SERIES, 100_000.0, risk)
    return _six(found, "ending_equity", "total_pnl", "win_rate", "average_win", "average_loss", "max_drawdown_pct")


def _exec_cte(name, source, direction, capital=CAPITAL):
    w = "(PARTITION BY symbol ORDER BY time)"
    return f"""{name}1 AS (SELECT *, coalesce(lag({direction}) OVER {w}, 0.0::DOUBLE) AS position FROM {source}),
{name}2 AS (SELECT *, coalesce(lag(position) OVER {w}, 0.0::DOUBLE) AS prev FROM {name}1),
{name}3 AS (SELECT *, last_value(CASE WHEN position <> prev AND position <> 0 THEN open END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY time ROWS UNBOUNDED PRECEDING) AS entry,
  last_value(CASE WHEN position <> prev AND position <> 0 THEN time END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY time ROWS UNBOUNDED PRECEDING) AS since FROM {name}2),
{name}4 AS (SELECT *, lag(entry) OVER {w} AS was, lag(since) OVER {w} AS was_since FROM {name}3),
{name}5 AS (SELECT *, CASE WHEN position <> prev AND prev <> 0 THEN (open - was) * prev END AS pnl FROM {name}4),
{name}6 AS (SELECT *, coalesce(sum(pnl) OVER (PARTITION BY symbol ORDER BY time ROWS UNBOUNDED PRECEDING), 0.0::DOUBLE) AS realized_pnl,
  CASE WHEN position <> 0 THEN (close - entry) * position ELSE 0.0::DOUBLE END AS unrealized_pnl FROM {name}5),
{name}7 AS (SELECT *, {capital}::DOUBLE + realized_pnl + unrealized_pnl AS equity FROM {name}6),
{name}8 AS (SELECT *, greatest({capital}::DOUBLE, max(equity) OVER (PARTITION BY symbol ORDER BY time ROWS UNBOUNDED PRECEDING)) AS peak_equity FROM {name}7),
{name} AS MATERIALIZED (SELECT *, CASE WHEN peak_equity <= 0 THEN 0.0 ELSE greatest((peak_equity - equity) / peak_equity * 100, 0.0) END AS drawdown_pct FROM {name}8)"""


_RUN = f"WITH {_SIGNAL_CTE}, {_exec_cte('x', 'sig', 'direction')}"


def _halt_sql(signals, capital):
    return f"""WITH {signals}, {_exec_cte('x', 'sig', 'direction', capital)},
h AS (SELECT *, max(drawdown_pct >= {LIMIT}) OVER (PARTITION BY symbol ORDER BY time ROWS UNBOUNDED PRECEDING) AS halted FROM x),
h2 AS (SELECT symbol, time, i, open, close, halted, CASE WHEN halted THEN 0.0::DOUBLE ELSE direction END AS allowed,
  CASE WHEN halted AND NOT coalesce(lag(halted) OVER (PARTITION BY symbol ORDER BY time), FALSE) THEN printf('Global DD %.2f%% >= limit {LIMIT:.2f}%%', drawdown_pct) ELSE '' END AS risk_reason FROM h),
{_exec_cte('y', 'h2', 'allowed', capital)}"""


_HALT = _halt_sql(_SIGNAL_CTE, CAPITAL)



def _filtered_cte(signals, adx):
    return f"""{signals}, {adx}, z AS (SELECT sig.*, round(a.v, {DIGITS}) AS adx FROM sig LEFT JOIN a USING (symbol, i)),
      k AS (SELECT *, CASE WHEN i < {max(SLOW, 2 * ADX_N)} OR f IS NULL OR g IS NULL OR adx IS NULL THEN 0 WHEN adx < {ADX_LEVEL} THEN 1 ELSE 2 END AS k FROM z),
      fil AS MATERIALIZED (SELECT * REPLACE (CASE WHEN k = 2 THEN direction ELSE 0.0::DOUBLE END AS direction, CASE k WHEN 0 THEN '{strategy.WARMUP}' WHEN 1 THEN 'adx_below_threshold' ELSE reason END AS reason) FROM k)"""


_ONE_KEY = f"SELECT * EXCLUDE (broker) REPLACE (broker || '/' || symbol AS symbol) FROM ({_MARKET})"
_MARKET_FILTERED = _filtered_cte(_signal_cte(_ONE_KEY, FAST, SLOW), _adx_cte(_moves(_NUMBERED_MARKET)))
_TWO_KEYS = "split_part(symbol, '/', 1) AS broker, split_part(symbol, '/', 2) AS symbol"


def _pause_sql(ctes, source, capital):
    return f"""WITH RECURSIVE {ctes},
p AS (
  SELECT symbol, -1::BIGINT AS i, NULL::TIMESTAMP AS time, {capital}::DOUBLE AS realised, 0.0::DOUBLE AS position, 0.0::DOUBLE AS entry, {capital}::DOUBLE AS equity, {capital}::DOUBLE AS peak,
    0.0::DOUBLE AS most, '' AS risk_reason, FALSE AS halted, FALSE AS dp, FALSE AS mp, {capital}::DOUBLE AS db, {capital}::DOUBLE AS mb, 0 AS nd, 0 AS nm, FALSE AS flatten, 0.0::DOUBLE AS target, NULL::DOUBLE AS pnl
  FROM (SELECT DISTINCT symbol FROM {source})
  UNION ALL
  SELECT symbol, i, time, realised, position, entry, equity, peak, greatest(most, dd),
    concat_ws('; ', CASE WHEN h AND NOT halted THEN printf('Global DD %.2f%% >= limit {LIMIT:.2f}%%', dd) END, CASE WHEN h1 THEN printf('Daily DD %.2f%% >= limit {DAILY:.2f}%%', greatest((db - equity) / db * 100, 0)) END,
      CASE WHEN h2 THEN printf('Monthly DD %.2f%% >= limit {MONTHLY:.2f}%%', greatest((mb - equity) / mb * 100, 0)) END), h, d OR h1, m OR h2, db, mb, nd + CASE WHEN h1 THEN 1 ELSE 0 END, nm + CASE WHEN h2 THEN 1 ELSE 0 END,
    h OR d OR h1 OR m OR h2, CASE WHEN h OR d OR h1 OR m OR h2 THEN 0.0::DOUBLE ELSE direction END, pnl
  FROM (
    SELECT *, halted OR dd >= {LIMIT} AS h, NOT d AND db > 0 AND greatest((db - equity) / db * 100, 0) >= {DAILY} AS h1, NOT m AND mb > 0 AND greatest((mb - equity) / mb * 100, 0) >= {MONTHLY} AS h2
    FROM (SELECT *, greatest(peak0, equity) AS peak, CASE WHEN greatest(peak0, equity) <= 0 THEN 0.0 ELSE greatest((greatest(peak0, equity) - equity) / greatest(peak0, equity) * 100, 0.0) END AS dd
      FROM (SELECT *, realised + CASE WHEN position <> 0 THEN (close - entry) * position ELSE 0.0 END AS equity
        FROM (SELECT s.symbol, s.i, s.time, s.close, s.direction, p.peak AS peak0, p.most, p.halted, p.nd, p.nm,
            p.realised + CASE WHEN p.target <> p.position AND p.position <> 0 THEN (s.open - p.entry) * p.position ELSE 0.0 END AS realised,
            p.target AS position, CASE WHEN p.target <> p.position AND p.position <> 0 THEN (s.open - p.entry) * p.position END AS pnl, CASE WHEN p.target <> p.position AND p.target <> 0 THEN s.open ELSE p.entry END AS entry,
            p.dp AND date_trunc('day', s.time) = date_trunc('day', p.time) AS d, p.mp AND date_trunc('month', s.time) = date_trunc('month', p.time) AS m,
            CASE WHEN p.time IS NOT NULL AND date_trunc('day', s.time) = date_trunc('day', p.time) THEN p.db ELSE p.equity END AS db,
            CASE WHEN p.time IS NOT NULL AND date_trunc('month', s.time) = date_trunc('month', p.time) THEN p.mb ELSE p.equity END AS mb
          FROM p JOIN {source} s ON s.symbol = p.symbol AND s.i = p.i + 1))))
)
"""


_PAUSED = "position, round(equity, 6) AS equity, round(most, 6) AS max_drawdown_pct, halted, flatten, nd AS daily_halts, nm AS monthly_halts"
_PAUSE = f"{_pause_sql(_SIGNAL_CTE, 'sig', CAPITAL)} SELECT symbol, time, {_PAUSED}, risk_reason FROM p WHERE i >= 0"


# -- expectancy

SCENARIOS = [expectancy.Scenario("A", 0.65, 10, 25), expectancy.Scenario("B", 0.45, 30, 10), expectancy.Scenario("C", 0.5, 12, 11, 2, 3, 0.25, 0.1)]


def expectancy_analytic(spark, base):
    return _six(expectancy.analytic(expectancy.scenario_table(spark, SCENARIOS)), "expectancy_per_trade", "variance_per_trade").drop("scenario")


def expectancy_sim(spark, base):
    return expectancy.simulate(expectancy.scenario_table(spark, SCENARIOS), 200, 5000, 10_000.0)


def expectancy_numpy(spark, base):
    return expectancy.simulate_numpy(spark, SCENARIOS, 200, 5000, 10_000.0)


def expectancy_published(spark, base):
    """The two scenarios whose figures are published, rounded as they are."""
    places = {"mean_ending_equity": 2, "median_ending_equity": 2, "std_ending_equity": 2, "probability_of_loss": 4, "mean_max_drawdown": 2}
    found = expectancy.simulate_numpy(spark, SCENARIOS[:2], 200, 5000, 10_000.0)
    return found.select("name", *[F.round(c, n).alias(c) for c, n in places.items()])


_VALUES = ", ".join(f"('{s.name}', {s.p_win}::DOUBLE, {s.avg_win}::DOUBLE, {s.avg_loss}::DOUBLE, {s.commission_per_trade + s.slippage}::DOUBLE)" for s in SCENARIOS)

QUERIES = {f.__name__: f for f in (
    bars_hourly, market_bars, validate_counts, dedupe_first_wins, yearly_split_counts, snapshot_meta, sma, ema, diff, lag, rescale, zscore, feature_pipeline,
    true_range_dm, adx, signal_ma, signal_adx, positions, trades, equity_curve, resized_positions, drawdown, global_halt, period_pause, metrics, market_backtest, market_ema, market_adx, market_signal_adx, market_period_pause, market_metrics,
    expectancy_analytic, expectancy_sim, expectancy_numpy, expectancy_published,
)}

SQL = {
    "market_ema": f"""WITH RECURSIVE b AS MATERIALIZED ({_NUMBERED_MARKET}), {_ema_sql(10)}, {_ema_sql(30)}
      SELECT split_part(symbol, '/', 1) AS broker, split_part(symbol, '/', 2) AS symbol, time, CASE WHEN i >= 9 THEN {_sig('x.v', 7)} END AS ema_10_close, CASE WHEN i >= 29 THEN {_sig('y.v', 7)} END AS ema_30_close
      FROM b JOIN e10 x USING (symbol, i) JOIN e30 y USING (symbol, i)""",
    "market_adx": f"""WITH RECURSIVE {_adx_cte(_moves(_NUMBERED_MARKET))} SELECT split_part(m.symbol, '/', 1) AS broker, split_part(m.symbol, '/', 2) AS symbol, m.time, round(a.v, 5) AS adx_{_P}
      FROM m LEFT JOIN a USING (symbol, i)""",
    "bars_hourly": _HOURLY,
    "market_bars": f"SELECT broker, symbol, time, open, high, low, close, volume FROM ({_MARKET})",
    "validate_counts": _VALIDATE,
    "dedupe_first_wins": _FIRST_WINS,
    "yearly_split_counts": "SELECT broker, symbol, CAST(year(time AT TIME ZONE 'UTC') AS INT) AS year, count(DISTINCT time) AS n_bars FROM bars GROUP BY ALL",
    "snapshot_meta": "SELECT snapshot_id, count(*) AS total_rows, CAST(floor(epoch(min(time))) AS BIGINT) AS range_start, CAST(floor(epoch(max(time))) AS BIGINT) AS range_end FROM snapshot_bars GROUP BY ALL",
    "sma": f"SELECT broker, symbol, time, {_sig('p')} AS sma_10_close, {_sig('q')} AS sma_200_close FROM (SELECT *, {_sql_sma(10, 'close', _B)} AS p, {_sql_sma(200, 'close', _B)} AS q FROM ({_MARKET}))",
    "ema": _EMA,
    "diff": f"{_SMA5} SELECT broker, symbol, time, round(v - lag(v) OVER ({_KEYED}), 6) AS sma_5_close_diff_1 FROM s",
    "lag": f"{_SMA5} SELECT broker, symbol, time, {_sig(f'lag(v, 3) OVER ({_KEYED})')} AS sma_5_close_lag_3 FROM s",
    "rescale": f"SELECT symbol, time, {_sig('(v / 200.0::DOUBLE * 2 - 1)')} AS rescaled FROM (SELECT *, {_sql_sma(5, 'close', 'symbol')} AS v FROM ({_HOURLY}))",
    "zscore": f"""SELECT symbol, time, CASE WHEN count(close) OVER w = 20 AND min(close) OVER w <> max(close) OVER w THEN round((close - avg(close) OVER w) / stddev_samp(close) OVER w, 6) END AS z
      FROM ({_HOURLY}) WINDOW w AS (PARTITION BY symbol ORDER BY time ROWS 19 PRECEDING)""",
    "feature_pipeline": _PIPE,
    "true_range_dm": f"SELECT symbol, time, tr AS true_range, pdm AS plus_dm, mdm AS minus_dm FROM ({_MOVES})",
    "adx": _ADX,
    "signal_ma": f"WITH {_SIGNAL_CTE} SELECT symbol, time, direction, abs(direction) AS strength, reason FROM sig",
    "signal_adx": f"WITH RECURSIVE {_filtered_cte(_SIGNAL_CTE, _ADX_CTE)} SELECT symbol, time, direction, abs(direction) AS strength, reason FROM fil",
    "market_signal_adx": f"WITH RECURSIVE {_MARKET_FILTERED} SELECT {_TWO_KEYS}, time, direction, abs(direction) AS strength, reason FROM fil",
    "market_metrics": f"""{_pause_sql(_MARKET_FILTERED, 'fil', 100_000.0)} SELECT split_part(symbol, '/', 1) AS broker, split_part(symbol, '/', 2) AS symbol, count(*) AS n_bars, min(time) AS start_ts, max(time) AS end_ts,
      100000.0::DOUBLE AS starting_capital, round(arg_max(equity, time), 6) AS ending_equity, count(pnl) AS n_trades, round(coalesce(sum(pnl), 0), 6) AS total_pnl,
      round(coalesce(avg(CASE WHEN pnl > 0 THEN 1.0 WHEN pnl IS NOT NULL THEN 0.0 END), 0), 6) AS win_rate, round(coalesce(avg(pnl) FILTER (pnl > 0), 0), 6) AS average_win,
      round(coalesce(avg(pnl) FILTER (pnl < 0), 0), 6) AS average_loss, round(max(most), 6) AS max_drawdown_pct, max(halted) AS risk_halted, min(time) FILTER (halted) AS risk_halted_at,
      {DAILY}::DOUBLE AS daily_drawdown_pct_limit, {MONTHLY}::DOUBLE AS monthly_drawdown_pct_limit, max(nd) AS daily_halts, max(nm) AS monthly_halts FROM p WHERE i >= 0 GROUP BY symbol""",
    "market_period_pause": f"{_pause_sql(_MARKET_FILTERED, 'fil', 100_000.0)} SELECT {_TWO_KEYS}, time, {_PAUSED} FROM p WHERE i >= 0",
    "positions": f"{_RUN} SELECT symbol, time, position FROM x",
    "trades": f"""{_RUN} SELECT symbol, was_since AS entry_ts, time AS exit_ts, CASE WHEN prev > 0 THEN 'long' ELSE 'short' END AS side, abs(prev) AS qty, was AS entry_price, open AS exit_price,
      round(pnl, 6) AS pnl FROM x WHERE pnl IS NOT NULL""",
    "equity_curve": f"{_RUN} SELECT symbol, time AS timestamp, round(equity, 6) AS equity, position, round(unrealized_pnl, 6) AS unrealized_pnl, round(realized_pnl, 6) AS realized_pnl FROM x",
    "resized_positions": f"""WITH {_SIGNAL_CTE}, z AS (SELECT *, coalesce(lag(direction * (1 + (i + 1) % 3)) OVER w * 0.5::DOUBLE, 0.0::DOUBLE) AS t FROM sig WINDOW w AS (PARTITION BY symbol ORDER BY time)),
      g AS (SELECT *, sum(CASE WHEN sign(t) <> coalesce(s, 0) THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY time ROWS UNBOUNDED PRECEDING) AS k
        FROM (SELECT *, lag(sign(t)) OVER (PARTITION BY symbol ORDER BY time) AS s FROM z)),
      q AS (SELECT *, first_value(t) OVER v AS position, CASE WHEN t <> 0 THEN first_value(open) OVER v END AS entry FROM g WINDOW v AS (PARTITION BY symbol, k ORDER BY time)),
      u AS (SELECT *, CASE WHEN k <> lag(k) OVER w AND lag(position) OVER w <> 0 THEN (open - lag(entry) OVER w) * lag(position) OVER w END AS fill_pnl FROM q WINDOW w AS (PARTITION BY symbol ORDER BY time))
      SELECT symbol, time, position, round(fill_pnl, 6) AS fill_pnl, round({CAPITAL}::DOUBLE + coalesce(sum(fill_pnl) OVER (PARTITION BY symbol ORDER BY time ROWS UNBOUNDED PRECEDING), 0)
        + CASE WHEN position <> 0 THEN (close - entry) * position ELSE 0 END, 6) AS equity FROM u""",
    "drawdown": f"""{_RUN} SELECT symbol, time, round(peak_equity, 6) AS peak_equity, round(drawdown_pct, 6) AS drawdown_pct,
      round(max(drawdown_pct) OVER (PARTITION BY symbol ORDER BY time ROWS UNBOUNDED PRECEDING), 6) AS max_drawdown_pct FROM x""",
    "global_halt": f"{_HALT} SELECT symbol, time, position, round(equity, 6) AS equity, halted, risk_reason FROM y",
    "period_pause": _PAUSE,
    "metrics": f"""{_HALT} SELECT symbol, count(*) AS n_bars, min(time) AS start_ts, max(time) AS end_ts, {CAPITAL}::DOUBLE AS starting_capital, round(arg_max(equity, time), 6) AS ending_equity,
      count(pnl) AS n_trades, round(coalesce(sum(pnl), 0), 6) AS total_pnl, round(coalesce(avg(CASE WHEN pnl > 0 THEN 1.0 WHEN pnl IS NOT NULL THEN 0.0 END), 0), 6) AS win_rate,
      round(coalesce(avg(pnl) FILTER (pnl > 0), 0), 6) AS average_win, round(coalesce(avg(pnl) FILTER (pnl < 0), 0), 6) AS average_loss, round(max(drawdown_pct), 6) AS max_drawdown_pct,
      max(halted) AS risk_halted, min(time) FILTER (halted) AS risk_halted_at, NULL::DOUBLE AS daily_drawdown_pct_limit, NULL::DOUBLE AS monthly_drawdown_pct_limit,
      0 AS daily_halts, 0 AS monthly_halts FROM y GROUP BY symbol""",
    "market_backtest": _halt_sql(_signal_cte(f"SELECT * EXCLUDE (broker) REPLACE (broker || '/' || symbol AS symbol) FROM ({_MARKET})", 10, 30), 100_000.0)
    + " SELECT symbol, count(*) AS n_bars, count(pnl) AS n_trades, round(coalesce(sum(pnl), 0), 4) AS total_pnl, round(arg_max(equity, time), 4) AS ending_equity, max(halted) AS risk_halted FROM y GROUP BY symbol",
    # the published figures of both scenarios (fixed values)
    "expectancy_published": """SELECT * FROM (VALUES ('A', 9551.29::DOUBLE, 9550.0::DOUBLE, 238.56::DOUBLE, 0.9672::DOUBLE, 550.36::DOUBLE), ('B', 11601.76, 11600.0, 282.82, 0.0, 86.2))
      AS t(name, mean_ending_equity, median_ending_equity, std_ending_equity, probability_of_loss, mean_max_drawdown)""",
    "expectancy_analytic": f"""SELECT name, round(p * w - (1 - p) * l - c, 6) AS expectancy_per_trade, round(p * (w - (p * w - (1 - p) * l)) ** 2 + (1 - p) * (-l - (p * w - (1 - p) * l)) ** 2, 6) AS variance_per_trade
      FROM (VALUES {_VALUES}) AS t(name, p, w, l, c)""",
}
