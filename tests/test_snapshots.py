import random

from tidemark.operators.snapshots import change_summary, snapshot_changes

BARS = "snapshot_id string, time bigint, close double, symbol string"
META = "snapshot_id string, symbol string, broker string, _idx int"


def brute(bars, meta):
    """Compare every snapshot with the one before, as sets."""
    chains = {}
    for s, sym, b, _ in meta:
        if s is not None:
            chains.setdefault(tuple(None if x is None else x.strip().upper() for x in (b, sym)), set()).add(s)
    held = {}
    for s, t, c, _ in bars:
        if s is None or t is None:
            continue
        c = None if c is None or c != c else c
        old = held.setdefault(s, {}).get(t)
        held[s][t] = c if old is None else old if c is None else max(old, c)
    out = set()
    for ids in chains.values():
        ids = sorted(ids)
        for a, b in zip(ids, ids[1:]):
            x, y = held.get(a, {}), held.get(b, {})
            out |= {(b, t, "added") for t in y.keys() - x.keys()} | {(b, t, "removed") for t in x.keys() - y.keys()}
            for t in x.keys() & y.keys():
                u, v = x[t], y[t]
                if (u is None) != (v is None) or (u is not None and abs(u - v) > 1e-6):
                    out.add((b, t, "changed"))
    return out


def run(spark, bars, meta):
    found = snapshot_changes(spark.createDataFrame(bars, BARS), spark.createDataFrame(meta, META)).collect()
    assert len(found) == len({(r["snapshot_id"], r["time"]) for r in found})
    return {(r["snapshot_id"], r["time"], r["change_kind"]) for r in found}


def test_against_brute_force(spark):
    rng = random.Random(3)
    meta, bars = [], []
    for chain, n in (("a", 9), ("b", 4), (None, 3), ("c", 1)):
        for i in range(n):
            s = f"{chain}{i}"
            meta.append((s, None if chain is None else rng.choice([chain, f" {chain.upper()} "]), "x", 1))
            if rng.random() < 0.15:
                continue  # a snapshot without bars
            for t in range(20):
                if rng.random() < 0.7:
                    close = rng.choice([1.0, 1.0 + 5e-7, 2.0, None, float("nan")])
                    bars += [(s, t, close, "clash")] * rng.choice([1, 1, 2])
    meta += meta[:3]
    bars += [("unknown", 1, 1.0, ""), (None, 1, 1.0, ""), ("a1", None, 1.0, "")]
    assert run(spark, bars, meta) == brute(bars, meta)


def test_gap_is_removed_and_added_again(spark):
    meta = [(s, "a", "x", 1) for s in "123"]
    bars = [("1", 5, 1.0, ""), ("2", 6, 1.0, ""), ("3", 5, 9.0, ""), ("3", 6, 1.0, "")]
    assert run(spark, bars, meta) == {("2", 5, "removed"), ("2", 6, "added"), ("3", 5, "added")}


def test_missing_is_neither_equal_nor_dust(spark):
    meta = [(s, "a", "x", 1) for s in "12"]
    bars = [("1", 1, None, ""), ("2", 1, float("nan"), ""), ("1", 2, None, ""), ("2", 2, 0.0, ""), ("1", 3, 1.0, ""), ("2", 3, 1.0000005, "")]
    assert run(spark, bars, meta) == {("2", 2, "changed")}


def test_empty_tables(spark):
    assert run(spark, [], []) == set()
    assert run(spark, [("1", 1, 1.0, "")], []) == set()
    assert run(spark, [], [("1", "a", "x", 1)]) == set()
    changes = snapshot_changes(spark.createDataFrame([], BARS), spark.createDataFrame([], META))
    assert change_summary(changes).count() == 0
