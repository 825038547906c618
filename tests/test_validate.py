import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators.validate import ARRIVAL, canonical, first_wins, validate_bars, validation_counts

SCHEMA = f"symbol string, time timestamp, open double, high double, low double, close double, spread int, {ARRIVAL} int"


def bars(spark, n=3, **change):
    rows = [["s", dt.datetime(2024, 1, 1, 0, 5 * i), 1.0, 2.0, 0.5, 1.5, 1, i] for i in range(n)]
    for at, (column, value) in change.get("at", {}).items():
        rows[at][SCHEMA.split(", ").index(next(c for c in SCHEMA.split(", ") if c.startswith(column + " ")))] = value
    return spark.createDataFrame([tuple(r) for r in rows], SCHEMA)


def test_valid(spark):
    validate_bars(bars(spark))
    validate_bars(bars(spark, at={1: ("spread", None)}))
    validate_bars(bars(spark).drop("spread", ARRIVAL, "open"))


@pytest.mark.parametrize("at,message", [
    ({1: ("time", None)}, "Null timestamps: 1"), ({1: ("time", dt.datetime(2024, 1, 1))}, "Duplicate timestamps: 1"), ({1: ("time", dt.datetime(2025, 1, 1))}, "not monotonic"),
    ({0: ("close", float("nan")), 1: ("open", None)}, r"OHLC columns: open \(1\), close \(1\)"), ({2: ("spread", -1)}, "Negative spread values: 1"),
    ({0: ("time", None), 1: ("close", None), 2: ("spread", -1)}, "Null timestamps"),
])
def test_first_fault_is_raised(spark, at, message):
    with pytest.raises(ValueError, match=message):
        validate_bars(bars(spark, at=at))


def test_no_time_and_no_bars(spark):
    with pytest.raises(ValueError, match="Missing 'time' column"):
        validate_bars(bars(spark).drop("time"))
    with pytest.raises(ValueError, match="No bars"):
        validate_bars(bars(spark).limit(0))
    with pytest.raises(ValueError, match="Missing 'time' column"):
        canonical(bars(spark).drop("time"))


def test_counts_by_key(spark):
    other = bars(spark, 2).withColumn("symbol", F.lit(None).cast("string"))
    got = {r["symbol"]: r for r in validation_counts(bars(spark, at={1: ("time", dt.datetime(2024, 1, 1))}).unionByName(other), ["symbol"]).collect()}
    assert got["s"]["duplicate_times"] == 1 and got[None]["duplicate_times"] == 0 and got[None]["n_rows"] == 2


def test_first_wins(spark):
    old = spark.createDataFrame([(1, "old", 9), (2, "old", 9)], f"time int, v string, {ARRIVAL} int")
    new = spark.createDataFrame([(2, "new", 1), (3, "b", 2), (3, "a", 1)], f"time int, v string, {ARRIVAL} int").withColumn("extra", F.lit(1))
    got = {r["time"]: (r["v"], r["extra"]) for r in first_wins(old, new, ["time"]).collect()}
    assert got == {1: ("old", None), 2: ("old", None), 3: ("a", 1)}
    assert first_wins(old.limit(0), new.limit(0), ["time"]).count() == 0


def test_canonical_order(spark):
    df = canonical(bars(spark).orderBy(F.desc("time")).coalesce(1), ["symbol"])
    assert [r["time"].minute for r in df.collect()] == [0, 5, 10] and len(list(df.toLocalIterator())) == 3
