import datetime as dt

import pytest

from tidemark.operators.regrid import empty_slots, regrid

SCHEMA = "broker string, symbol string, time timestamp, close double, arrived_utc timestamp, value string, status int"


def at(s, us=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s, microseconds=us)


def rows_of(spark, rows, **kw):
    df = spark.createDataFrame([(b, s, at(t), c, at(a), "x", 1) for b, s, t, c, a in rows], SCHEMA)
    base = int(dt.datetime(2024, 1, 1, tzinfo=dt.UTC).timestamp())
    return {(r["broker"], r["symbol"], (r["slot_epoch"] - base) // 300): (r["value"], r["status"], r["n_readings"]) for r in regrid(df, **kw).collect()}


def test_fills_and_marks(spark):
    found = rows_of(spark, [("b", "s", 0, 1.0, 0), ("b", "s", 10, 2.0, 0), ("b", "s", 910, 5.0, 0), ("b", "s", 910 + 4800, 7.0, 0)])
    assert found["b", "s", 0] == (2.0, "observed", 2)
    assert found["b", "s", 1][1:] == ("filled", 0) and found["b", "s", 1][0] == pytest.approx(2 + 3 * 290 / 900)
    assert found["b", "s", 2][0] == pytest.approx(2 + 3 * 590 / 900)
    assert found["b", "s", 3] == (5.0, "observed", 1)
    assert all(found["b", "s", k] == (None, "missing", 0) for k in range(4, 19))
    assert found["b", "s", 19] == (7.0, "observed", 1) and len(found) == 20


@pytest.mark.parametrize("block", [1, 3, 2016])
def test_blocks_make_no_difference(spark, block):
    rows = [(b, s, t, float(t), 0) for b, s in (("b", "s"), ("b", None), (None, None)) for t in (3, 400, 2000, 2100, 9000, 40000)]
    assert rows_of(spark, rows, block_slots=block) == rows_of(spark, rows, block_slots=100_000)


def test_latest_delivery_holds_and_missing_is_none(spark):
    found = rows_of(spark, [("b", "s", 5, 1.0, 0), ("b", "s", 5, 3.0, 9), ("b", "s", 305, None, 0), ("b", "s", 310, float("nan"), 0), ("b", "s", 700, 4.0, 0), ("b", "t", 1, None, 0)])
    assert found["b", "s", 0] == (3.0, "observed", 2) and found["b", "s", 1][1] == "filled" and len(found) == 3


def test_slot_bounds_and_single_reading(spark):
    found = rows_of(spark, [("b", "s", 299, 1.0, 0), ("b", "s", 300, 2.0, 0), ("c", "s", 77, 2.0, 0)])
    assert {k[2] for k in found if k[0] == "b"} == {0, 1} and found["c", "s", 0][1] == "observed"


def test_long_gap_is_expanded_whole(spark):
    found = rows_of(spark, [("b", "s", 0, 1.0, 0), ("b", "s", 300 * 10_000, 2.0, 0)])
    assert len(found) == 10_001


def test_before_1970_and_empty(spark):
    df = spark.createDataFrame([("b", "s", dt.datetime(1969, 12, 31, 23, 59, 59), 1.0, None, "x", 1), ("b", "s", dt.datetime(1970, 1, 1, 0, 6), 1.0, None, "x", 1)], SCHEMA)
    assert sorted(r["slot_epoch"] for r in regrid(df).collect()) == [-300, 0, 300]
    assert empty_slots(regrid(df)).count() == 1
    assert regrid(spark.createDataFrame([], SCHEMA)).count() == 0
