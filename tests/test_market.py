import numpy as np
import pandas as pd

from tidemark.operators.features import ADX
from tidemark.plans import bar_queries as q

AT = ["broker", "symbol", "time"]


def ordered(df):
    return df.toPandas().sort_values(AT).reset_index(drop=True)


def test_recurrences_of_every_series(spark, tables):
    bars, ema, adx, signal = (ordered(f(spark, tables)) for f in (q.market_bars, q.market_ema, q.market_adx, q.market_signal_adx))
    assert len(bars) and bars[AT].equals(ema[AT]) and bars[AT].equals(adx[AT]) and bars[AT].equals(signal[AT])
    for _, rows in bars.groupby(["broker", "symbol"], dropna=False):
        for n in (10, 30):
            value, want = None, []
            for i, c in enumerate(rows.close):
                value = c if value is None else value + 2 / (n + 1) * (c - value)
                want.append(value if i >= n - 1 else np.nan)
            np.testing.assert_allclose(ema.loc[rows.index, f"ema_{n}_close"].astype(float), want, rtol=1e-7)
        want = ADX(q.ADX_N).fold(rows)[f"adx_{q.ADX_N}"]
        np.testing.assert_allclose(adx.loc[rows.index, f"adx_{q.ADX_N}"].astype(float), want, atol=1e-5)
    low = adx[f"adx_{q.ADX_N}"] < q.ADX_LEVEL - 1e-4
    assert low.any() and (signal.direction[low] == 0).all() and (signal.direction != 0).any()


def test_limits_of_every_series(spark, tables):
    bars, pause = (ordered(f(spark, tables)) for f in (q.market_bars, q.market_period_pause))
    found = q.market_metrics(spark, tables).toPandas().set_index(["broker", "symbol"])
    assert bars[AT].equals(pause[AT]) and len(found) == len(bars[["broker", "symbol"]].drop_duplicates())
    for key, rows in pause.groupby(["broker", "symbol"]):
        m = found.loc[key]
        assert m.n_bars == len(rows) and m.risk_halted == rows.halted.any() and abs(m.ending_equity - rows.equity.iloc[-1]) < 1e-5
        assert m.daily_halts == rows.daily_halts.iloc[-1] and m.monthly_halts == rows.monthly_halts.iloc[-1]
        assert (rows.position.to_numpy()[1:][rows.flatten.to_numpy()[:-1]] == 0).all()
