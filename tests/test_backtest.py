import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import backtest, strategy
from tidemark.operators.backtest import RiskConfig
from tidemark.operators.features import FeaturePipeline, Frame

FRAME = Frame(("symbol",))
SCHEMA = "symbol string, time timestamp, open double, high double, low double, close double, volume double"


def path(closes, step=dt.timedelta(hours=1), start=dt.datetime(2024, 1, 1), symbol="s", times=None):
    """Bars that open at the close before."""
    prev, rows = closes[0], []
    for i, c in enumerate(closes):
        t = times[i] if times else start + i * step
        rows.append((symbol, t, float(prev), float(max(prev, c)) + 1, float(min(prev, c)) - 1, float(c), 1.0))
        prev = c
    return rows


def signals(spark, rows, fast=2, slow=5):
    made, specs = strategy.build_strategy({"type": "ma_crossover", "fast_period": fast, "slow_period": slow})
    return strategy.with_signal(FeaturePipeline(specs).transform(spark.createDataFrame(rows, SCHEMA)), made, FRAME)


def curve(spark, rows, capital=100.0, risk=RiskConfig(), **kw):
    return backtest.run(signals(spark, rows, **kw), FRAME, capital, 1.0, risk)


def frame_of(df):
    return df.orderBy("symbol", "time").toPandas()


RAMP = [50] * 10 + list(range(55, 101, 5)) + [30] * 20


def test_hand_computed_flip_and_open_end(spark):
    bars = [(10, 11), (12, 12), (13, 15), (14, 9), (8, 7), (6, 5)]
    rows = [("s", dt.datetime(2024, 1, 1, i), float(o), 99.0, 0.0, float(c), 1.0) for i, (o, c) in enumerate(bars)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("direction", F.element_at(F.array(*[F.lit(float(x)) for x in (1, 1, -1, -1, 0, 1)]), F.hour("time") + 1))
    out = frame_of(backtest.run(df, FRAME, 100.0, 2.0))
    assert out["position"].tolist() == [0, 2, 2, -2, -2, 0]
    assert out["equity"].tolist() == [100, 100, 106, 114, 118, 120]
    t = backtest.trades(backtest.run(df, FRAME, 100.0, 2.0), FRAME).orderBy("entry_ts").collect()
    assert [(r["side"], r["qty"], r["entry_price"], r["exit_price"], r["pnl"], r["entry_ts"].hour, r["exit_ts"].hour) for r in t] == [
        ("long", 2.0, 12.0, 14.0, 4.0, 1, 3), ("short", 2.0, 14.0, 6.0, 16.0, 3, 5)]
    open_end = backtest.metrics(backtest.run(df.where(F.hour("time") < 5), FRAME, 100.0, 2.0), FRAME, 100.0).first()
    assert open_end["n_trades"] == 1 and open_end["total_pnl"] == 4.0 and open_end["ending_equity"] == 118.0 and open_end["win_rate"] == 1.0


@pytest.mark.parametrize("limit", [None, 1.0, 5.0, 30.0])
def test_windows_equal_the_fold(spark, limit):
    rng = random.Random(11)
    rows = []
    for s in ("a", "b", None):
        p, closes = 100.0, []
        for _ in range(150):
            p = round(max(1.0, p + rng.gauss(0, 2)), 2)
            closes.append(p)
        rows += path(closes, symbol=s)
    risk = RiskConfig(limit)
    sig = signals(spark, rows, 3, 8)
    a, b = frame_of(backtest.run_set_based(sig, FRAME, 1000.0, 1.0, limit)), frame_of(backtest.run_with_pauses(sig, FRAME, 1000.0, 1.0, risk))
    for c in ("position", "fill_pnl", "equity", "drawdown_pct", "max_drawdown_pct", "fill_entry_price"):
        pd.testing.assert_series_equal(a[c], b[c], check_dtype=False, rtol=1e-9)
    for c in ("halted", "risk_reason", "flatten", "fill_side", "fill_entry_ts"):
        assert a[c].astype(str).tolist() == b[c].astype(str).tolist()


def test_global_halt_is_for_good(spark):
    out = frame_of(curve(spark, path(RAMP), risk=RiskConfig(5.0)))
    first = int(out["halted"].idxmax())
    assert out["halted"].iloc[first:].all() and not out["halted"].iloc[:first].any()
    assert (out["position"].iloc[first + 1:] == 0).all() and out["position"].iloc[first] != 0
    assert out["risk_reason"].iloc[first].startswith("Global DD ") and out["risk_reason"].iloc[first].endswith(">= limit 5.00%") and (out["risk_reason"].iloc[first + 1:] == "").all()
    m = backtest.metrics(curve(spark, path(RAMP), risk=RiskConfig(5.0)), FRAME, 100.0, RiskConfig(5.0)).first()
    assert m["risk_halted"] and m["risk_halted_at"] == out["time"].iloc[first].to_pydatetime()


def test_daily_pause_ends_with_the_day(spark):
    closes = [50] * 5 + [60, 70, 80, 90, 100] + [30] * 2 + [30, 40, 50, 60, 70, 80, 90, 100, 110, 120, 130, 140]
    times = [dt.datetime(2024, 1, 1 + i // 12, i % 12) for i in range(24)]
    out = frame_of(curve(spark, path(closes, times=times), risk=RiskConfig(daily_drawdown_pct=3.0)))
    day1 = out[out["time"].dt.day == 1]
    hit = int(day1["flatten"].idxmax())
    assert day1["flatten"].iloc[hit:].all() and day1["daily_halts"].iloc[-1] == 1 and not out["halted"].any()
    day2 = out[out["time"].dt.day == 2]
    assert (day2["position"] != 0).any() and day2["position"].iloc[0] == 0


def test_monthly_pause_ends_with_the_month(spark):
    closes = [50] * 5 + [60, 70, 80, 90, 100, 100] + [30] * 5 + [30, 45, 60, 75, 90, 105, 120, 135]
    times = [dt.datetime(2024, 1, 28) + i * dt.timedelta(hours=6) for i in range(16)] + [dt.datetime(2024, 2, 1) + i * dt.timedelta(hours=6) for i in range(8)]
    out = frame_of(curve(spark, path(closes, times=times), risk=RiskConfig(monthly_drawdown_pct=3.0)))
    assert out["monthly_halts"].iloc[-1] == 1
    february = out[out["time"].dt.month == 2]
    assert (february["position"] != 0).any() and not february["flatten"].iloc[0]


@pytest.mark.parametrize("equity,want", [([100, 105, 110, 120], 0), ([100, 120, 90, 130], 25), ([100, 150, 140, 160, 120], 25), ([100, 100, 100, 80], 20)])
def test_drawdown(spark, equity, want):
    df = spark.createDataFrame([("s", i, float(e)) for i, e in enumerate(equity)], "symbol string, time int, equity double")
    out = backtest.with_drawdown(df, FRAME, 100.0).orderBy("time").toPandas()
    assert out["max_drawdown_pct"].iloc[-1] == pytest.approx(want) and (out["drawdown_pct"] >= 0).all() and out["peak_equity"].is_monotonic_increasing


def test_drawdown_without_capital(spark):
    df = spark.createDataFrame([("s", 1, -5.0)], "symbol string, time int, equity double")
    assert backtest.with_drawdown(df, FRAME, 0.0).first()["drawdown_pct"] == 0.0


def test_trades_sum_to_realised_and_empty(spark):
    c = curve(spark, path(RAMP))
    m = backtest.metrics(c, FRAME, 100.0).first()
    last = c.orderBy(F.desc("time")).first()
    assert m["total_pnl"] == pytest.approx(last["realized_pnl"]) and m["ending_equity"] == last["equity"] and m["n_bars"] == 40
    assert backtest.trades(c, FRAME).count() == m["n_trades"]
    none = curve(spark, [])
    assert none.count() == 0 and backtest.metrics(none, FRAME, 100.0).count() == 0
    assert curve(spark, [], risk=RiskConfig(daily_drawdown_pct=1.0)).count() == 0
    flat = backtest.metrics(curve(spark, path([50] * 20)), FRAME, 100.0).first()
    assert (flat["n_trades"], flat["total_pnl"], flat["win_rate"], flat["average_win"], flat["average_loss"]) == (0, 0.0, 0.0, 0.0, 0.0)


def test_signal_branches(spark):
    made = strategy.Crossover("f", "g", 2, "adx", 25.0)
    rows = [(1, 2.0, 1.0, 30.0), (2, 2.0, 1.0, 30.0), (3, 2.0, 1.0, 24.9), (4, 2.0, 1.0, 25.0), (5, 1.0, 2.0, 30.0), (6, 1.0, 1.0, 30.0), (7, None, 1.0, 30.0), (8, 1.0, float("nan"), 30.0), (9, 1.0, 2.0, None)]
    df = spark.createDataFrame([("s", *r) for r in rows], "symbol string, time int, f double, g double, adx double")
    got = {r["time"]: (r["direction"], r["strength"], r["reason"]) for r in strategy.with_signal(df, made, FRAME).collect()}
    warm = (0, 0, strategy.WARMUP)
    assert got == {1: warm, 2: warm, 3: (0, 0, "adx_below_threshold"), 4: (1, 1, "cross_above"), 5: (-1, 1, "cross_below"), 6: (0, 0, "equal"), 7: warm, 8: warm, 9: warm}
    assert {r["reason"] for r in strategy.with_signal(df.drop("adx"), made, FRAME).collect()} == {strategy.WARMUP}


def test_registry():
    config = {"type": "adx_filtered", "fast_period": 10, "slow_period": 30, "adx_period": 20}
    made, specs = strategy.build_strategy(config)
    assert made.warmup_bars == 40 and len(specs) == 3 and "type" in config and made.adx_threshold == 25.0
    made, specs = strategy.build_strategy({"type": "ma_crossover", "fast_period": 10, "slow_period": 30, "indicator_type": "other"})
    assert made.fast == "sma_10_close" and made.warmup_bars == 30
    assert strategy.build_strategy({"type": "ma_crossover", "fast_period": 10, "slow_period": 30, "indicator_type": "ema"})[0].slow == "ema_30_close"
    with pytest.raises(ValueError, match="'type' key"):
        strategy.build_strategy({})
    with pytest.raises(ValueError, match="Unknown strategy type"):
        strategy.build_strategy({"type": "x"})
    strategy.register("mine", lambda **kw: (kw, []))
    assert strategy.build_strategy({"type": "mine", "a": 1}) == ({"a": 1}, [])


@pytest.mark.parametrize("risk", [RiskConfig(), RiskConfig(5.0), RiskConfig(5.0, 3.0)])
def test_clashing_columns_are_replaced(spark, risk):
    clean = curve(spark, path(RAMP), risk=risk)
    sig = signals(spark, path(RAMP)).withColumns({"position": F.lit("x"), "equity": F.lit(1), "halted": F.lit("y"), "note": F.lit("kept")})
    dirty = backtest.run(sig, FRAME, 100.0, 1.0, risk)
    columns = ["time", "position", "equity", "halted", "drawdown_pct"]
    assert sorted(map(tuple, dirty.select(columns).collect())) == sorted(map(tuple, clean.select(columns).collect()))
    assert dirty.columns.count("position") == 1 and dirty.where("note = 'kept'").count() == 40
    again = strategy.with_signal(sig, strategy.Crossover("sma_2_close", "sma_5_close", 5), FRAME)
    assert again.columns.count("direction") == 1 and again.where("direction != 0").count() > 0


@pytest.mark.parametrize("wanted,closed,end", [((1, 2, 2, 1, 0, 0), 1, 1004.0), ((1, 3, -2, -1, None, 1), 2, None), ((0.5, 0.25, float("nan"), 2, 2, -1), 1, None)])
def test_size_changes_of_one_sign_are_ignored_with_and_without_limits(spark, wanted, closed, end):
    rows = [("s", dt.datetime(2024, 1, 1, i), 100.0 + i, 120.0, 90.0, 100.5 + i, 1.0, None if w is None else float(w)) for i, w in enumerate(wanted)]
    df = spark.createDataFrame(rows, SCHEMA + ", direction double")
    plain, limited = (frame_of(backtest.run(df, FRAME, 1000.0, 1.0, r)) for r in (RiskConfig(), RiskConfig(None, 99.0)))
    for c in ("position", "fill_pnl", "equity"):
        pd.testing.assert_series_equal(plain[c], limited[c])
    assert plain["fill_pnl"].notna().sum() == closed and (end is None or plain["equity"].iloc[-1] == end)


def test_drawdown_check_sees_a_wrong_curve(spark):
    good = curve(spark, path(RAMP))
    assert backtest.drawdown_error(good, FRAME, 100.0).first()["error"] < 1e-10
    assert backtest.drawdown_error(good.withColumn("max_drawdown_pct", F.col("max_drawdown_pct") + 1), FRAME, 100.0).first()["error"] > 0.9
