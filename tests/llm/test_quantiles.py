import datetime as dt
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.functions.buckets import log_width
from tidemark.llm.quantiles import live_sketch, merge_sketches, once, percentiles, sketch

PS = [0.0, 0.1, 0.5, 0.9, 0.99, 1.0]


def check(found, values, error):
    s = sorted(values)
    for r in found:
        true = s[math.floor(r["p"] * (len(s) - 1))]
        assert r["n_values"] == len(s)
        if math.isinf(true):
            assert r["estimate"] == true
        else:
            assert abs(r["estimate"] - true) <= error * abs(true) * (1 + 1e-9) + 5e-324


@pytest.mark.parametrize("error", [0.001, 0.01, 0.2])
def test_error_is_bounded(spark, error):
    rng = random.Random(5)
    vs = [rng.choice([-1, 1]) * math.exp(rng.gauss(0, 6)) for _ in range(3000)] + [0.0, -0.0, 1e300, -1e300, 5e-324, float("inf"), float("-inf")] + [7.0] * 500
    df = spark.createDataFrame([("g", v, 1) for v in vs] + [("g", None, 1), ("g", float("nan"), 1), (None, 2.0, 1)], "grp string, v double, idx int")
    rows = percentiles(sketch(df, ["grp"], "v", error), ["grp"], PS, error).collect()
    check([r for r in rows if r["grp"] == "g"], vs, error)
    assert {r["estimate"] for r in rows if r["grp"] is None} == {2.0}


def test_parts_merge_to_the_whole(spark):
    df = spark.createDataFrame([(f"d{i % 7}", "a", float(i % 101 - 50)) for i in range(2000)], "day string, grp string, v double")
    whole = sorted(map(tuple, sketch(df, ["grp"], "v").collect()))
    parts = sketch(df.where("day < 'd3'"), ["grp", "day"], "v").unionByName(sketch(df.where("day >= 'd3'"), ["grp", "day"], "v"))
    assert sorted(map(tuple, merge_sketches(parts, ["grp"]).collect())) == whole


def test_empty_and_bad_arguments(spark):
    df = spark.createDataFrame([], "grp string, v double")
    assert percentiles(sketch(df, ["grp"], "v"), ["grp"], PS).count() == 0
    assert sketch(spark.createDataFrame([("a", None)], "grp string, v double"), ["grp"], "v").count() == 0
    with pytest.raises(ValueError):
        log_width(1.5)
    with pytest.raises(ValueError):
        percentiles(df, ["grp"], [1.5])
    with pytest.raises(ValueError, match="named like those of a sketch: n"):
        sketch(df.withColumnRenamed("grp", "n"), ["n"], "v")
    with pytest.raises(ValueError, match="Missing columns: nix"):
        sketch(df, ["grp"], "nix")


@settings(max_examples=300, deadline=None)
@given(st.floats(min_value=1e-300, max_value=1e300), st.sampled_from([0.001, 0.01, 0.1]))
def test_bucket_middle_is_within_the_error(x, error):
    w = log_width(error)
    i = math.ceil(math.log(x) / w)
    assert abs(math.exp((i - 1) * w) * 2 * math.exp(w) / (math.exp(w) + 1) - x) <= error * x


def test_sketch_of_closed_windows(spark, tmp_path):
    rows = [("a", dt.datetime(2024, 1, 1 + i // 50, 1), float(i)) for i in range(200)] + [("a", dt.datetime(2024, 2, 1), 1.0), ("a", dt.datetime(2024, 1, 1), float("nan"))]
    schema = "grp string, at timestamp, v double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in2"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in2"))
    q = live_sketch(stream, ["grp"], "v", "at").writeStream.format("memory").queryName("sk").outputMode("append").option("checkpointLocation", str(tmp_path / "sk")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    out = spark.table("sk")
    assert {r["from_time"].day for r in out.select("from_time").distinct().collect()} == {1, 2, 3, 4}
    r = percentiles(merge_sketches(out, ["grp"]), ["grp"], [0.5]).first()
    assert r["n_values"] == 200 and abs(r["estimate"] - 99) <= 0.01 * 99


def test_rows_once(spark):
    rows = [("a", 1.0, "x"), ("a", 1.0, "x"), ("a", 1.0, "y"), (None, None, None), (None, None, None), ("a", float("nan"), "x"), ("a", float("nan"), "x")]
    df = spark.createDataFrame(rows, "g string, v double, _h1 string")
    assert once(df, ["g", "v"]).count() == 4 and once(df.limit(0), ["g"]).count() == 0
