import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators.features import ADX, EMA, SMA, Diff, FeaturePipeline, FeatureSpec, Frame, Indicator, Lag, Recurrence, Rescale, Transform, ZScore, directional_moves, true_range
from tidemark.schema import coalesce_volume, missing_as_null

START = dt.datetime(2024, 1, 1)


def bars(spark, closes, symbol="s", spread=1.0, **cols):
    rows = [(symbol, START + dt.timedelta(hours=i), c, None if c is None else c + spread, None if c is None else c - spread, c, 1000.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, time timestamp, open double, high double, low double, close double, volume double")


def values(spark, df, specs):
    pipe = FeaturePipeline(specs)
    out = pipe.features(df).orderBy("symbol", "time").toPandas()
    return out.drop(columns=["symbol", "time"])


def test_averages_match_pandas(spark):
    rng = np.random.default_rng(1)
    x = np.round(100 + rng.normal(size=120).cumsum(), 5)
    got = values(spark, bars(spark, x.tolist()), [FeatureSpec(SMA(10)), FeatureSpec(EMA(12)), FeatureSpec(SMA(10), (ZScore(20),))])
    s = pd.Series(x)
    np.testing.assert_allclose(got["sma_10_close"], s.rolling(10).mean(), rtol=1e-12)
    np.testing.assert_allclose(got["ema_12_close"], s.ewm(span=12, min_periods=12, adjust=False).mean(), rtol=1e-12)
    m = s.rolling(10).mean()
    np.testing.assert_allclose(got["sma_10_close_zscore_20"], (m - m.rolling(20).mean()) / m.rolling(20).std(), rtol=1e-6)


def test_flat_price_that_binary_fractions_cannot_hold(spark):
    got = values(spark, bars(spark, [5.3] * 5 + [0.1] * 60), [FeatureSpec(SMA(10)), FeatureSpec(SMA(30))])
    assert (got.iloc[40:]["sma_10_close"] == 0.1).all() and (got.iloc[40:]["sma_30_close"] == 0.1).all()


def test_missing_values_empty_the_window(spark):
    x = [1.0, 2.0, None, 4.0, 5.0, 6.0]
    got = values(spark, bars(spark, x), [FeatureSpec(SMA(2)), FeatureSpec(EMA(3))])
    assert got["sma_2_close"].isna().tolist() == [True, False, True, True, False, False]
    np.testing.assert_allclose(got["ema_3_close"], pd.Series(x, dtype=float).ewm(span=3, min_periods=3, adjust=False).mean())


def test_adx_against_plain_loop(spark):
    rng = np.random.default_rng(7)
    c = 100 + rng.normal(size=80).cumsum()
    h, lo = c + rng.uniform(0.1, 1, 80), c - rng.uniform(0.1, 1, 80)
    rows = [("s", START + dt.timedelta(hours=i), float(c[i]), float(h[i]), float(lo[i]), float(c[i]), 1.0) for i in range(80)]
    df = spark.createDataFrame(rows, "symbol string, time timestamp, open double, high double, low double, close double, volume double")
    p = 5
    tr, pd_, md = [np.nan], [np.nan], [np.nan]
    for i in range(1, 80):
        tr.append(max(h[i] - lo[i], abs(h[i] - c[i - 1]), abs(lo[i] - c[i - 1])))
        up, dn = h[i] - h[i - 1], lo[i - 1] - lo[i]
        pd_.append(up if up > dn and up > 0 else 0.0)
        md.append(dn if dn > up and dn > 0 else 0.0)
    a, b, e = sum(tr[1:p + 1]), sum(pd_[1:p + 1]), sum(md[1:p + 1])
    dx = {}
    for i in range(p, 80):
        if i > p:
            a, b, e = a - a / p + tr[i], b - b / p + pd_[i], e - e / p + md[i]
        dx[i] = 100 * abs(b - e) / (b + e) if b + e else 0.0
    want = [np.nan] * 80
    want[2 * p] = np.mean([dx[i] for i in range(p + 1, 2 * p + 1)])
    for i in range(2 * p + 1, 80):
        want[i] = (want[i - 1] * (p - 1) + dx[i]) / p
    np.testing.assert_allclose(values(spark, df, [FeatureSpec(ADX(p))])["adx_5"], want, rtol=1e-9)
    moves = df.select("time", true_range(Frame(("symbol",))).alias("t"), *[m.alias(n) for m, n in zip(directional_moves(Frame(("symbol",))), "ab")]).orderBy("time").toPandas()
    np.testing.assert_allclose(moves["t"], tr)
    np.testing.assert_allclose(moves["a"], pd_)


def test_adx_warmup_short_and_zero_range(spark):
    assert values(spark, bars(spark, np.linspace(1, 50, 100).tolist()), [FeatureSpec(ADX(14))])["adx_14"].isna().sum() == 28
    assert values(spark, bars(spark, np.linspace(1, 50, 100).tolist()), [FeatureSpec(ADX(14))])["adx_14"].iloc[-1] > 40
    assert values(spark, bars(spark, [1.0] * 20), [FeatureSpec(ADX(14))])["adx_14"].isna().all()
    assert values(spark, bars(spark, [1.0] * 60, spread=0.0), [FeatureSpec(ADX(14))])["adx_14"].isna().all()


def test_transforms_names_and_order(spark):
    specs = [FeatureSpec(SMA(5), (Diff(1), Lag(2))), FeatureSpec(SMA(10), alias="slow"), FeatureSpec(SMA(5), (Rescale(0, 100, 0, 10),)), FeatureSpec(SMA(1), (Rescale(3, 3),), alias="same")]
    pipe = FeaturePipeline(specs)
    assert pipe.names() == sorted(["sma_5_close_diff_1_lag_2", "slow", "sma_5_close_rescale_0_100", "same"])
    assert pipe.max_lookback == 10 and specs[0].lookback == 8
    x = pd.Series(np.arange(30.0) ** 2)
    got = values(spark, bars(spark, x.tolist()), specs)
    m = x.rolling(5).mean()
    np.testing.assert_allclose(got["sma_5_close_diff_1_lag_2"], m.diff().shift(2))
    np.testing.assert_allclose(got["sma_5_close_rescale_0_100"], m / 10)
    np.testing.assert_allclose(got["same"], x)
    assert list(got.columns) == pipe.names()


def test_zscore_of_constant_or_single(spark):
    got = values(spark, bars(spark, [100.0] * 50), [FeatureSpec(SMA(1), (ZScore(10),), alias="z"), FeatureSpec(SMA(1), (ZScore(1),), alias="one")])
    assert got["z"].isna().all() and got["one"].isna().all()


def test_errors(spark):
    df = bars(spark, [1.0, 2.0])
    with pytest.raises(ValueError, match="Duplicate feature names: sma_5_close"):
        FeaturePipeline([FeatureSpec(SMA(5)), FeatureSpec(SMA(5))]).transform(df)
    with pytest.raises(ValueError, match="Duplicate feature names: close"):
        FeaturePipeline([FeatureSpec(SMA(5), alias="close")]).transform(df)
    with pytest.raises(ValueError, match="Source column"):
        FeaturePipeline([FeatureSpec(SMA(5, "nix"))]).transform(df)
    with pytest.raises(ValueError, match="volume"):
        FeaturePipeline([]).transform(df.drop("volume"))


def test_no_specs_and_empty_bars(spark):
    df = bars(spark, [1.0, 2.0])
    assert FeaturePipeline([]).features(df).columns == ["symbol", "time"]
    assert FeaturePipeline([FeatureSpec(SMA(3)), FeatureSpec(EMA(3))]).transform(df.limit(0)).count() == 0


def test_protocols():
    assert isinstance(EMA(3), Recurrence) and not isinstance(SMA(3), Recurrence) and isinstance(Diff(1), Transform)

    class Spread:
        name, lookback = "range", 0

        def columns(self, frame):
            return {"range": F.col("high") - F.col("low")}

    assert isinstance(Spread(), Indicator)


def test_own_indicator(spark):
    class Bands:
        name, lookback, outputs = "bands", 0, ("top", "bottom")

        def columns(self, frame):
            return {"top": F.col("high") * 2, "bottom": F.col("low") * 2}

    got = values(spark, bars(spark, [1.0, 2.0]), [FeatureSpec(Bands(), alias="ignored")])
    assert list(got.columns) == ["bottom", "top"] and got["top"].tolist() == [4.0, 6.0]


def test_one_shuffle_for_a_pipeline(spark):
    plan = FeaturePipeline([FeatureSpec(SMA(5), (Diff(1),)), FeatureSpec(SMA(50)), FeatureSpec(SMA(9, "volume"), (ZScore(5),))]).transform(bars(spark, [1.0]))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1


def test_volume_and_nan(spark):
    df = spark.createDataFrame([(1.0, 2, 3)], "close double, tick_volume bigint, real_volume bigint")
    assert coalesce_volume(df).first()["volume"] == 2 and coalesce_volume(df.drop("tick_volume")).first()["volume"] == 3
    assert "volume" not in coalesce_volume(df.select("close")).columns
    assert missing_as_null(spark.createDataFrame([(float("nan"), "a")], "x double, y string")).first()["x"] is None


def test_split_series_give_the_same(spark):
    rng = np.random.default_rng(5)
    df, base = None, int(START.replace(tzinfo=dt.UTC).timestamp() * 1e6)
    for sym, n, gap in (("a", 900, 1), ("b", 40, 30), (None, 3, 1)):
        part = bars(spark, np.round(100 + rng.normal(size=n).cumsum(), 4).tolist(), symbol=sym)
        part = part.withColumn("time", F.timestamp_micros((F.unix_micros("time") - base) * gap + base))
        df = part if df is None else df.unionByName(part)
    pipe = FeaturePipeline([FeatureSpec(SMA(7), (Diff(2),)), FeatureSpec(EMA(4)), FeatureSpec(ADX(3)), FeatureSpec(SMA(3, "volume"))])
    order = lambda d: d.orderBy("symbol", "time").toPandas()
    whole = order(pipe.transform(df))
    pd.testing.assert_frame_equal(order(pipe.transform_split(df)), whole, rtol=1e-12)
    small = pipe.transform_split(df, block_rows=1)  # as short as memory allows
    pd.testing.assert_frame_equal(order(small), whole, rtol=1e-12)
    assert pipe.transform_split(df.limit(0)).count() == 0


def test_split_series_look_ahead_and_keep_nulls(spark):
    rng = np.random.default_rng(6)
    walk = lambda n: np.round(100 + rng.normal(size=n).cumsum(), 4).tolist()
    flat = bars(spark, [5.0] * 30 + walk(900), symbol="flat at first").withColumns({c: F.when(F.col("close") == 5, 5.0).otherwise(F.col(c)) for c in ("high", "low")})
    df = bars(spark, walk(500) + [100.0] * 200 + walk(500), symbol="flat between").unionByName(flat)
    df = df.withColumns({c: F.when((F.col("close") == 100), 100.0).otherwise(F.col(c)) for c in ("high", "low")})
    specs = [FeatureSpec(SMA(7), (Lag(-3),)), FeatureSpec(SMA(40), (Lag(-60), Diff(2))), FeatureSpec(SMA(5), (Diff(-4), Lag(2))), FeatureSpec(EMA(4), (Lag(-3),)), FeatureSpec(ADX(3)), FeatureSpec(ADX(4), (Lag(-1),))]
    pipe = FeaturePipeline(specs)
    order = lambda d: d.orderBy("symbol", "time").toPandas()
    whole = order(pipe.transform(df))
    first = whole[whole.symbol == "flat at first"]
    assert first.adx_3.isna().all() and whole[whole.symbol == "flat between"].adx_3.notna().sum() > 1000
    for block_rows in (50_000, 1):
        pd.testing.assert_frame_equal(order(pipe.transform_split(df, block_rows)), whole, rtol=1e-12)


def test_halo_reaches_over_short_blocks(spark):
    from tidemark.functions.blocks import halo

    rows = [("s", b, i) for i, b in enumerate([0, 0, 0, 1, 2, 2, 5, 5, 5, 5, 9])] + [(None, 0, 1), (None, 1, 2)]
    core = spark.createDataFrame(rows, "k string, _block bigint, t int")
    got = {(r["k"], r["_block"], r["t"]) for r in halo(core, ["k"], "t", 3).collect()}
    want = {(k, b, t) for k in ("s", None) for b in {r[1] for r in rows if r[0] == k} for t in sorted(r[2] for r in rows if r[0] == k and r[1] < b)[-3:]}
    assert got == want
    got = {(r["k"], r["_block"], r["t"]) for r in halo(core, ["k"], "t", 3, after=True).collect()}
    assert got == {(k, b, t) for k in ("s", None) for b in {r[1] for r in rows if r[0] == k} for t in sorted(r[2] for r in rows if r[0] == k and r[1] > b)[:3]}


@pytest.mark.parametrize("scale", [1e-300, 1e-15, 1.0, 1e20, 1e300])
def test_averages_of_any_magnitude(spark, scale):
    values = [0.1] * 12 + [5.3, 0.1] + [0.1] * 12 + [3.7, 2.2, None, 9.1, 1.3, 4.4, float("inf"), 1.0, 2.0, 3.0, 0.0, -2.5]
    rows = [("s", i, 1.0, 1.0, 1.0, None if v is None else v * scale, 1.0) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "symbol string, time int, open double, high double, low double, close double, volume double")
    for period in (1, 3, 10):
        got = [r[f"sma_{period}_close"] for r in FeaturePipeline([FeatureSpec(SMA(period))]).features(df).orderBy("time").collect()]
        for i, g in enumerate(got):
            w = values[max(0, i - period + 1):i + 1]
            if len(w) < period or any(v is None or math.isinf(v) for v in w):
                assert g is None
            elif len(set(w)) == 1:
                assert g == w[0] * scale
            else:
                want = math.fsum(v * scale for v in w) / period
                assert math.isclose(g, want, rel_tol=1e-15, abs_tol=0.0)


def test_wilder_recurrence_against_a_loop():
    from tidemark.operators.features import _smooth, _wilder_sum

    rng = np.random.default_rng(4)
    x, p = rng.random(200), 7
    s = x[:p].sum()
    want = [s]
    for v in x[p:]:
        s = s - s / p + v
        want.append(s)
    np.testing.assert_allclose(_wilder_sum(x, p), want, rtol=1e-12)
    x[50] = np.nan
    assert np.isnan(_smooth(1.0, x, p)[51:]).all() and not np.isnan(_smooth(1.0, x, p)[:51]).any()
