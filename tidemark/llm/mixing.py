"""Mixing sources to target weights by pivotal dependent rounding.

Every record of a source has the same expected number of copies. The whole part is sure; the fractions are rounded so that the tokens
of the source stay what they should be: fractional records are paired and mass is moved between them at random until one of the
two is whole. What is left of each shard (at most one record) is combined in a reduction tree over the shards.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage, ship

EPS = 1e-9


def _trade(x, w, i, j, rng) -> None:
    """One trade of mass in every pair i[k], j[k], in place."""
    xi, xj, r = x[i], x[j], w[j] / w[i]
    up, down = np.minimum(1 - xi, xj * r), np.minimum(xi, (1 - xj) * r)
    rise = rng.random(len(i)) * (up + down) < down  # up with probability down/(up+down)
    step = np.where(rise, up, -down)
    for k, v in ((i, xi + step), (j, xj - step / r)):
        x[k] = np.where(v < EPS, 0.0, np.where(v > 1 - EPS, 1.0, v))


def round_dependently(x: np.ndarray, w: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Round the fractions `x` to 0 or 1 with sum(w*x) kept, all but at most one.

    Every pair moves mass so that w[i]*x[i] + w[j]*x[j] stays and each x keeps its expectation; one of them becomes whole, the other goes on
    to the next round with another partner. Values of 0 and 1 stay; weights are positive.
    """
    x, w = np.clip(np.asarray(x, float).copy(), 0.0, 1.0), np.asarray(w, float)
    x[x < EPS], x[x > 1 - EPS] = 0.0, 1.0
    octave = np.floor(np.log2(w)).astype(int)
    hub = -1
    # Heavy records first. What an octave leaves trades with the lighter records one by one until it is whole, so what stays fractional
    # in the end is light, or a heavy record that all of the lighter ones couldn't settle.
    for o in np.unique(octave)[::-1]:
        live = np.flatnonzero((octave == o) & (x > 0) & (x < 1))
        at = 0
        while hub >= 0 and at < len(live):
            _trade(x, w, np.array([hub]), live[at:at + 1], rng)
            hub = next((k for k in (hub, live[at]) if 0 < x[k] < 1), -1)
            at += 1
            if hub == live[at - 1]:
                at, hub = at - 1, -1  # the heavy one is whole, the light one goes on with its own octave
        live = live[at:]
        while len(live) > 1:
            n = len(live) // 2 * 2
            _trade(x, w, live[0:n:2], live[1:n:2], rng)
            live = live[(x[live] > 0) & (x[live] < 1)]
        if len(live):
            hub = live[0]
    return x


def rates(targets: pd.DataFrame, sizes: dict[str, tuple[int, int]], total: float | None = None) -> pd.DataFrame:
    """Copies per record of each source of each mix: columns mix_id, source, target_share, max_repeats, rate.

    `sizes` has (tokens, records) by source. Sources without tokens or repeats can't contribute. Without `total` the size of a mix is the greatest at which all
    other sources reach their shares within their repeats; with it, sources stop at their repeats and the report shows what is missing.
    Targets with a null mix, source or share, or a share not above 0, count as a share of 0; a null number of repeats as 0.
    """
    t = targets.copy()
    t["target_share"] = t["target_share"].fillna(0.0).clip(lower=0.0)
    t["max_repeats"] = t["max_repeats"].fillna(0).clip(lower=0).astype(int)
    t["tokens"] = [sizes.get(s, (0, 0))[0] for s in t["source"]]
    t["rate"] = 0.0
    for _, rows in t.groupby("mix_id"):
        can = rows[(rows.tokens > 0) & (rows.target_share > 0) & (rows.max_repeats > 0)]
        if not len(can):
            continue
        size = (can.max_repeats * can.tokens / can.target_share).min() if total is None else float(total)
        t.loc[can.index, "rate"] = np.minimum(can.max_repeats, can.target_share * size / can.tokens)
    return t.drop(columns="tokens")


def _seed(*parts) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "little")


def _settler(seed: int, level: int, last: bool):
    def settle(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_id", "_w"], kind="stable", na_position="last")
        rng = np.random.default_rng(_seed(seed, level, *key))
        order = rng.permutation(len(pdf))
        x = pdf["_x"].to_numpy(float).copy()
        x[order] = round_dependently(x[order], np.maximum(pdf["_w"].to_numpy(float)[order], 1.0), rng)
        if last:  # the one record of a source that is still fractional
            at = np.flatnonzero((x > 0) & (x < 1))
            x[at] = rng.random(len(at)) < x[at]
        return pdf.assign(_x=x)

    return settle


def mix(
    docs: DataFrame, targets: DataFrame, id: str = "doc_id", source: str = "source", size: str = "n_tokens",
    total: float | None = None, seed: int = 0, shard_rows: int = 20_000, fan_in: int = 1000,
) -> tuple[DataFrame, DataFrame]:
    """How often each record is used in each mix, and the shares really reached.

    Returns (copies, report). `copies` has one row per mix and record of its sources: `mix_id`, source, id, size, `copies` (0 up to
    the source's repeats). `report` has one row per mix and target: records, copies and tokens used, `actual_share`, `target_share`, `max_repeats` and
    the greatest number of copies. Records with a null source, or one that no mix names, are in no mix; records of size 0 or null get no copies.
    Records with the same id are separate records. A target whose source has no records reaches 0, and the others share the
    mix in proportion. `targets` is a small table of settings: it is read to the driver. `docs` is read several times, so it should be cut from its
    lineage if it is dear to compute. Empty tables give empty results.
    """
    ship(docs.sparkSession)
    slim = docs.select(
        F.col(source).alias("_source"), F.col(id).alias("_id"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("bigint").alias("_w")
    )
    wanted = targets.select("mix_id", "source", "target_share", "max_repeats").where(F.col("mix_id").isNotNull() & F.col("source").isNotNull())
    plan = wanted.groupBy("mix_id", "source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).toPandas()
    names = sorted(set(plan["source"]))
    # one row per source that a target names: bounded by the table of targets
    sums = slim.where(F.col("_source").isin(names)).groupBy("_source").agg(F.sum("_w").alias("t"), F.count(F.lit(1)).alias("n")).collect() if names else []
    sizes = {r["_source"]: (r["t"], r["n"]) for r in sums}
    plan = rates(plan, sizes, total)
    plan["shards"] = [max(1, -(-sizes.get(s, (0, 0))[1] // shard_rows)) for s in plan["source"]]
    spark = docs.sparkSession
    settings = spark.createDataFrame(
        [(r.mix_id, r.source, float(r.target_share), int(r.max_repeats), float(r.rate), int(r.shards)) for r in plan.itertuples()],
        "mix_id string, _msource string, target_share double, max_repeats int, rate double, _shards int",
    )
    part = settings.select("mix_id", "_msource", "rate", "_shards")
    rows = slim.join(F.broadcast(part), F.col("_source") == F.col("_msource")).drop("_msource")
    whole = F.floor(F.col("rate") + EPS)
    fraction = F.greatest(F.col("rate") - whole, F.lit(0.0))
    # the shard decides only who is paired with whom; the place of a row keeps many records of one id and size from sharing one
    rows = rows.select(
        "mix_id", "_source", "_id", "_w", F.when(F.col("_w") > 0, whole).otherwise(0).cast("bigint").alias("_whole"),
        F.when(F.col("_w") > 0, fraction).otherwise(0.0).alias("_x"),
        F.pmod(F.xxhash64("_id", "_w", F.monotonically_increasing_id(), F.lit(seed)), F.col("_shards")).cast("bigint").alias("_shard"),
    )
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in rows.columns)
    levels = 1 + max(0, math.ceil(math.log(max(plan["shards"], default=1), fan_in)))
    done = None
    for level in range(levels):
        settle = _settler(seed, level, level == levels - 1)
        settled = rows.groupBy("mix_id", "_source", "_shard").applyInPandas(settle, schema)
        if level < levels - 1:  # both what is ready and what goes on come from it
            settled = cut_lineage(settled)
        open_ = (F.col("_x") > 0) & (F.col("_x") < 1)
        ready = settled.where(~open_)
        done = ready if done is None else done.unionByName(ready)
        rows = settled.where(open_).withColumn("_shard", F.floor(F.col("_shard") / fan_in).cast("bigint"))
    copies = done.select("mix_id", F.col("_source").alias(source), F.col("_id").alias(id), F.col("_w").alias(size), (F.col("_whole") + F.col("_x").cast("bigint")).alias("copies"))
    used = copies.groupBy("mix_id", F.col(source).alias("_s")).agg(
        F.count(F.lit(1)).alias("n_records"), F.sum("copies").alias("n_copies"), F.sum(F.col("copies") * F.col(size)).alias("tokens"), F.max("copies").alias("most_copies")
    )
    both = settings.join(used.withColumnRenamed("mix_id", "_m"), (F.col("mix_id") == F.col("_m")) & (F.col("_msource") == F.col("_s")), "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("n_records", "n_copies", "tokens", "most_copies")}
    per_mix = both.groupBy(F.col("mix_id").alias("_m2")).agg(F.sum("tokens").alias("_all"))
    report = both.drop("_m").join(per_mix, F.col("mix_id") == F.col("_m2")).select(
        "mix_id", F.col("_msource").alias("source"), *zero.values(), "target_share",
        F.coalesce(F.try_divide("tokens", "_all"), F.lit(0.0)).alias("actual_share"), "max_repeats",
    )
    return copies, report
