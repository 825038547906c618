import datetime as dt
import random

import numpy as np
import pytest

from tidemark.functions import robust
from tidemark.operators import outliers
from tidemark.operators.outliers import implausible

SCHEMA = "broker string, symbol string, time timestamp, open double, high double, low double, close double, spread bigint, arrived_utc timestamp, score string, _t int"
START = dt.datetime(2024, 3, 1)


def walk(n, seed, tick=0.01, level=100.0):
    rng, p, out = random.Random(seed), level, []
    for _ in range(n):
        o = p
        p = round(p + rng.gauss(0, 5) * tick, 4)
        out.append([o, max(o, p) + tick * rng.random() * 3, min(o, p) - tick * rng.random() * 3, p, rng.randint(8, 14)])
    return out


def frame(spark, series):
    rows = [(b, s, START + dt.timedelta(minutes=5 * i), *bar, START, "clash", 1) for (b, s), bars in series.items() for i, bar in enumerate(bars)]
    return spark.createDataFrame(rows, SCHEMA)


def found(df, **kw):
    return {(r["broker"], r["symbol"], int((r["time"] - START).total_seconds()) // 300): (r["impossible"], r["spike"], r["stuck"]) for r in implausible(df, **kw).collect()}


@pytest.fixture(scope="module")
def faulty():
    a = walk(700, 1)
    a[100][3] *= 10  # close
    a[200][1:4] = [x * 1.05 for x in a[200][1:4]]  # spike of the bar
    a[201][1:4] = [x * 1.05 for x in a[201][1:4]]
    a[300][4] = 900  # spread
    a[320][4] = -3
    a[400][1], a[400][2] = a[400][2], a[400][1]
    for i in range(451, 463):  # twelve repeats
        a[i] = [a[450][3], *a[450][1:4], 10]
    for i in range(550, 700):  # a move that holds
        a[i][:4] = [x * 1.5 for x in a[i][:4]]
    a[640][3] = None
    want = {100: (True, True, False), 200: (False, True, False), 201: (False, True, False), 300: (False, True, False), 320: (True, False, False), 400: (True, False, False)}
    want |= {i: (False, False, True) for i in range(451, 463)}
    return a, want


@pytest.mark.parametrize("block_s", [None, 86_400, 3 * 3600])
def test_kinds_of_faults_in_any_blocks(spark, faulty, block_s):
    a, want = faulty
    df = frame(spark, {("b", "s"): a, ("b", None): walk(300, 2), (None, "s"): walk(5, 3)})
    got = found(df.unionByName(df.limit(50)), block_s=block_s)
    mine = {k[2]: v for k, v in got.items() if k[:2] == ("b", "s")}
    assert mine == want
    assert not {k for k in got if k[:2] != ("b", "s")}


def test_constant_series_has_no_cases(spark):
    flat = [[1.0, 1.0, 1.0, 1.0, 2]] * 300
    got = found(frame(spark, {("b", "s"): flat}))
    assert not [v for v in got.values() if v[1]]


def test_empty_and_all_missing(spark):
    assert implausible(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [("b", "s", None, None, None, None, None, None, None, "", 1), ("b", "s", START, None, None, float("nan"), None, None, None, "", 1)]
    assert implausible(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_latest_delivery_holds(spark):
    bars = walk(200, 4)
    bad = [*bars[50][:3], 5000.0, 10]
    df = frame(spark, {("b", "s"): bars})
    at = START + dt.timedelta(minutes=5 * 50)
    late = spark.createDataFrame([("b", "s", at, *bad, START + dt.timedelta(days=1), "", 1)], SCHEMA)
    early = spark.createDataFrame([("b", "s", at, *bad, START - dt.timedelta(days=1), "", 1)], SCHEMA)
    assert set(found(df.unionByName(late))) == {("b", "s", 50)}
    assert not found(df.unionByName(early))


def test_hampel_against_plain_medians():
    rng = np.random.default_rng(0)
    x = rng.normal(size=60)
    x[[7, 30]] = np.nan
    dev, scale = robust.hampel_of_changes(x, 3, 4)
    y = x[~np.isnan(x)]
    padded, change = np.concatenate(([y[0]] * 3, y, [y[-1]] * 3)), np.abs(np.diff(y))
    change = np.concatenate((change[:1], change))
    wide = np.concatenate(([change[0]] * 4, change, [change[-1]] * 4))
    assert np.isnan(dev[[7, 30]]).all() and np.isnan(scale[[7, 30]]).all()
    for k, i in enumerate(np.flatnonzero(~np.isnan(x))):
        assert dev[i] == y[k] - np.median(padded[k:k + 7]) and scale[i] == np.median(wide[k:k + 9])
    assert robust.hampel_of_changes(np.array([]), 3, 4)[0].size == 0 and robust.hampel_of_changes(np.array([2.0]), 3, 4)[1].tolist() == [0.0]


def test_rolling_deviation_decides(spark):
    """A wild stretch has no spikes at its own scale; with the source's scale alone it would be full of them."""
    bars = walk(900, 5)
    wild = random.Random(9)
    for i in range(400, 500):
        factor = 1 + wild.uniform(-0.02, 0.02)
        bars[i][:4] = [x * factor for x in bars[i][:4]]
    bars[700][3] = round(bars[700][3] * 1.03, 4)
    bars[700][1] = max(bars[700])
    df = frame(spark, {("b", "s"): bars})
    assert {k[2] for k in found(df) if not 390 < k[2] < 415 and not 485 < k[2] < 510} == {700}
    plain = robust.hampel_of_changes(np.log(np.array([b[3] for b in bars])), 5, 10)
    move = np.median(np.abs(np.diff(np.log([b[3] for b in bars]))))
    assert (np.abs(plain[0][415:486]) > 10 * robust.MAD_TO_SIGMA * move).sum() > 10


@pytest.mark.parametrize("block_s", [None, 86_400, 3 * 3600, 1200])
def test_runs_of_any_length_in_any_blocks(spark, block_s):
    """Runs longer than blocks and halos are whole; in a slow series long repeats are normal."""
    bars = walk(300, 6)
    bars[50:50] = [list(bars[49]) for _ in range(400)]
    slow, rng = [], random.Random(3)
    while len(slow) < 4000:
        bar = walk(1, len(slow), level=50 + rng.random())[0]
        slow += [list(bar)] * (1 + min(200, int(rng.expovariate(1 / 9))))
    slow = slow[:4000]
    got = found(frame(spark, {("b", "s"): bars, ("b", "slow"): slow}), block_s=block_s)
    assert {k for k, v in got.items() if v[2]} == {("b", "s", i) for i in range(50, 450)}


def test_hundred_thousand_repeats(spark):
    df = spark.range(100_000).selectExpr("'b' AS broker", "'s' AS symbol", "timestamp_seconds(1700000000 + id * 300) AS time", "1.5D AS high", "1.0D AS low", "1.2D AS close", "3L AS spread")
    moving = spark.range(5000).selectExpr("'b' AS broker", "'s' AS symbol", "timestamp_seconds(1600000000 + id * 300) AS time", "2D + (id % 97) / 100 AS high", "1.0D + (id % 97) / 100 AS low", "1.2D + (id % 97) / 100 AS close", "3L AS spread")
    got = implausible(df.unionByName(moving), block_s=40 * 86_400)
    assert got.where("stuck").count() == 99_999 and got.count() == 99_999


def test_blocks_dont_change_what_is_normal(spark, faulty):
    df = frame(spark, {("b", "s"): faulty[0], ("b", "t"): walk(400, 12)})
    core = [outliers._readings(df, ("broker", "symbol"), "time", "arrived_utc", s)[1] for s in (None, 3600, 86_400)]
    stats = [{tuple(r) for r in outliers._normal(c, ["_s0", "_s1"], 5e6).select("_s1", "_move", "_s25", "_s75", "_fresh", "_runs", "_n1", "_n2", "_n3").distinct().collect()} for c in core]
    assert stats[0] == stats[1] == stats[2] and len(stats[0]) == 2


def test_impossible_alone(spark, faulty):
    df = frame(spark, {("b", "s"): faulty[0], (None, "s"): walk(5, 3)})
    df = df.unionByName(df.limit(300))
    want = {(r["broker"], r["symbol"], r["time"]) for r in implausible(df).where("impossible").collect()}
    assert {tuple(r) for r in outliers.impossible(df).collect()} == want and len(want) == 3
    assert outliers.impossible(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeat_limit():
    assert robust.repeat_limit(0, 0, 0, 0, 0) == 5 and robust.repeat_limit(1000, 4, 0, 0, 0) == 5
    limits = [robust.repeat_limit(1000, 100, 100 - k, k, k // 3) for k in (0, 10, 30, 60)]
    assert limits == sorted(limits) and limits[0] < limits[-1]
    # runs that go on nine times in ten: no upper bound
    assert robust.repeat_limit(1e6, 3e6, 3e5, 2.7e5, 2.4e5) > 150


def test_long_repeats_of_a_part():
    x = np.array([[1.0], [1.0], [np.nan], [2.0], [3.0], [3.0]])
    assert robust.long_repeats(x, 3).sum() == 0
    assert robust.long_repeats(x, 3, head=4, linked=True).tolist() == [True, True, False, False, False, False]
    assert robust.long_repeats(x, 3, tail=4).tolist() == [False] * 5 + [True]
    assert robust.long_repeats(np.full((3, 1), np.nan), 1).sum() == 0 and robust.long_repeats(np.ones((4, 1)), 2, 9, 9, True).all()
