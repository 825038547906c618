import numpy as np
import pandas as pd
import pytest

from tidemark.llm.mixing import mix, rates, round_dependently

TARGETS = "mix_id string, source string, target_share double, max_repeats int"


def test_rounding_keeps_totals_and_expectation():
    rng = np.random.default_rng(4)
    w = np.exp(rng.normal(5, 1, 300)).round() + 1
    x = rng.random(300)
    x[:5] = [0, 1, 0, 1, 0.5]
    sums = np.zeros(300)
    for k in range(400):
        y = round_dependently(x, w, np.random.default_rng(k))
        open_ = (y > 0) & (y < 1)
        assert open_.sum() <= 1 and abs((w * y).sum() - (w * x).sum()) < 1e-6
        assert y[0] == y[2] == 0 and y[1] == y[3] == 1
        sums += y
    assert np.abs(sums / 400 - x).max() < 0.12 and abs((sums / 400 - x).mean()) < 0.01


def test_rounding_of_nothing_and_one():
    rng = np.random.default_rng(0)
    assert len(round_dependently(np.zeros(0), np.zeros(0), rng)) == 0
    assert round_dependently(np.array([0.3]), np.array([2.0]), rng).tolist() == [0.3]


def test_rates_reach_the_shares_within_the_repeats():
    t = pd.DataFrame({"mix_id": ["m"] * 4, "source": ["a", "b", "none", "c"], "target_share": [0.5, 0.3, 0.1, None], "max_repeats": [1, 4, 2, None]})
    got = rates(t, {"a": (1000, 10), "b": (100, 5), "c": (7, 1)}).set_index("source")["rate"]
    assert got["none"] == got["c"] == 0 and got["b"] == 4 and got["a"] == pytest.approx(400 / 0.3 * 0.5 / 1000)
    capped = rates(t, {"a": (1000, 10), "b": (100, 5)}, total=10_000).set_index("source")["rate"]
    assert capped["a"] == 1 and capped["b"] == 4


@pytest.mark.parametrize("repeats", [None, 0, -1])
def test_a_source_without_repeats_leaves_the_mix_to_the_others(repeats):
    t = pd.DataFrame({"mix_id": ["m"] * 3, "source": ["a", "b", "c"], "target_share": [0.5, 0.3, 0.2], "max_repeats": [1, 4, repeats]})
    sizes = {"a": (1000, 10), "b": (100, 5), "c": (70, 1)}
    got = rates(t, sizes).set_index("source")["rate"]
    assert got["c"] == 0 and got["b"] == 4 and got["a"] == pytest.approx(400 / 0.3 * 0.5 / 1000)
    assert rates(t, sizes, total=10_000)["rate"].tolist() == [1, 4, 0]


def docs(spark, n=6000):
    rng = np.random.default_rng(2)
    rows = [(i if i % 11 else 0, ["a", "b", "c", "b", None, "other"][min(5, int(rng.exponential(1.5)))], int(rng.lognormal(5, 1)) if i % 13 else [0, None][i % 2], "clash") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens int, copies string")


@pytest.mark.parametrize("shard_rows", [50, 100_000])
def test_shares_and_copies(spark, shard_rows):
    df = docs(spark)
    targets = spark.createDataFrame([("m", "a", 0.3, 2), ("m", "b", 0.6, 3), ("m", "c", 0.1, 1), ("n", "b", 1.0, 2), ("n", "gone", 0.5, 2), (None, "a", 1.0, 1)], TARGETS)
    copies, report = mix(df, targets, shard_rows=shard_rows, fan_in=8)
    c = copies.toPandas()
    per = df.groupBy("source").count().toPandas().set_index("source")["count"]
    assert len(c) == per["a"] + 2 * per["b"] + per["c"]
    assert (c.loc[c.n_tokens == 0, "copies"] == 0).all() and c.copies.min() >= 0
    most = c.groupby(["mix_id", "source"]).copies.max()
    assert most["m", "a"] <= 2 and most["m", "b"] <= 3 and most["m", "c"] <= 1 and most["n", "b"] == 2
    for r in report.collect():
        mine = c[(c.mix_id == r["mix_id"]) & (c.source == r["source"])]
        assert (r["n_records"], r["n_copies"], r["tokens"]) == (len(mine), mine.copies.sum(), (mine.copies * mine.n_tokens).sum())
        want = {("n", "b"): 1.0, ("n", "gone"): 0.0}.get((r["mix_id"], r["source"]), r["target_share"])
        assert r["actual_share"] == pytest.approx(want, abs=0.004)
    again = mix(df, targets, shard_rows=shard_rows, fan_in=8)[0].toPandas()
    key = ["mix_id", "source", "doc_id", "n_tokens", "copies"]
    assert sorted(map(tuple, c[key].fillna(-1).values)) == sorted(map(tuple, again[key].fillna(-1).values))


def test_empty(spark):
    none, targets = docs(spark, 0), spark.createDataFrame([("m", "a", 1.0, 1)], TARGETS)
    copies, report = mix(none, targets)
    assert copies.count() == 0 and [(r["tokens"], r["actual_share"]) for r in report.collect()] == [(0, 0.0)]
    copies, report = mix(docs(spark, 50), targets.limit(0))
    assert copies.count() == 0 and report.count() == 0


def test_records_of_one_id_and_size_are_spread(spark):
    docs = spark.range(0, 3000, 1, 6).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "'a' AS source", "10L AS n_tokens").unionByName(spark.createDataFrame([(1, "b", 20_000)], "doc_id bigint, source string, n_tokens bigint"))
    targets = spark.createDataFrame([("m", "a", 0.6, 1), ("m", "b", 0.4, 1)], "mix_id string, source string, target_share double, max_repeats int")
    copies, report = mix(docs, targets, shard_rows=100, fan_in=4)
    got = {r["source"]: r for r in report.collect()}
    assert got["a"]["n_records"] == 3000 and abs(got["a"]["actual_share"] - 0.6) < 0.001
