"""Implausible readings: impossible values, spikes and stuck stretches, judged source by source.

Every source is cut into blocks of time, so that none is larger than a task's memory however many of all rows
it has. A block sees a few readings of its neighbours on either side, and runs of repeats are carried from block to block in a table of one row per block,
so that neither windows nor runs end at a cut. What is normal for a source comes from mergeable bucket counts over all of its readings.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import buckets, robust
from tidemark.functions.blocks import halo, same_keys, with_blocks
from tidemark.functions.cols import no_nan, require
from tidemark.session import cut_lineage, ship

HALO = 48  # readings of the neighbouring blocks
ERROR = 0.01  # relative, of the median changes and quartiles
FIELDS = ("high", "low", "close", "spread")


def _slim(df: DataFrame, source: tuple[str, ...], time: str, version: str) -> tuple[list[str], DataFrame]:
    keys = [f"_s{i}" for i in range(len(source))]
    us = F.unix_micros(F.col(time).cast("timestamp"))
    ver = F.unix_micros(F.col(version).cast("timestamp")) if version in df.columns else F.lit(0).cast("bigint")
    return keys, df.where(F.col(time).isNotNull()).select(
        *[F.col(s).alias(k) for s, k in zip(source, keys)], us.alias("_t"), ver.alias("_ver"),
        *[no_nan(F.col(c).cast("double")).alias(c) for c in FIELDS],
    )


def _once(rows: DataFrame, at: list[str]) -> DataFrame:
    """Of readings of one time the newest, in one pass over each partition."""
    newest = Window.partitionBy(*at).orderBy("_t", F.desc_nulls_last("_ver"), *[F.desc_nulls_last(c) for c in FIELDS])
    told = rows.repartition(*at).withColumn("_before", F.lag("_t").over(newest))
    return told.where(F.col("_before").isNull() | (F.col("_before") != F.col("_t"))).drop("_before", "_ver")


def _readings(df: DataFrame, source: tuple[str, ...], time: str, version: str, block_s: int | None) -> tuple[list[str], DataFrame]:
    keys, rows = _slim(df, source, time, version)
    rows = with_blocks(rows, keys, "_t") if block_s is None else rows.withColumn("_block", F.floor(F.col("_t") / F.lit(block_s * 1_000_000)).cast("bigint"))
    return keys, _once(rows, [*keys, "_block"])


def impossible(df: DataFrame, source: tuple[str, ...] = ("broker", "symbol"), time: str = "time", version: str = "arrived_utc", max_price: float = 5e6) -> DataFrame:
    """The readings that are impossible by themselves, as in `implausible`: source columns and time. Needs no neighbours, so one exchange by source and time."""
    require(df, *source, time, *FIELDS)
    keys, rows = _slim(df, source, time, version)
    once = rows.groupBy(*keys, "_t").agg(F.max(F.struct("_ver", *FIELDS)).alias("_r")).select(*keys, "_t", "_r.*")
    high, low, close, spread = (F.col(c) for c in FIELDS)
    absurd = F.array_max(F.array(*[F.coalesce((x <= 0) | (x >= max_price), F.lit(False)) for x in (high, low, close)]))
    found = once.where(F.coalesce(high < low, F.lit(False)) | F.coalesce(close > high, F.lit(False)) | F.coalesce(close < low, F.lit(False)) | F.coalesce(spread < 0, F.lit(False)) | absurd)
    return found.select(*[F.col(k).alias(s) for s, k in zip(source, keys)], F.timestamp_micros("_t").alias(time))


def implausible(
    df: DataFrame,
    source: tuple[str, ...] = ("broker", "symbol"),
    time: str = "time",
    version: str = "arrived_utc",
    half_window: int = 5,
    half_scale: int = 10,
    sigmas: float = 10.0,
    max_price: float = 5e6,
    block_s: int | None = None,
) -> DataFrame:
    """The readings that are impossible, spikes or stuck: source columns, time, three flags and `score`.

    * `impossible`: high below low, close outside low to high, a price not above zero or of `max_price` or more, or a
      negative spread.
    * `spike`: a Hampel filter. The logarithm of a price, or a spread, is further than `sigmas` deviations from the rolling median of `2*half_window+1` readings. The
      deviation is the rolling median absolute change of `2*half_scale+1` readings, but at least the source's own: for prices the median of its changes that aren't zero, for spreads
      half their interquartile range and one unit. A source whose price never changes has no price spikes. The former level must be back after at most `half_window` readings.
    * `stuck`: high, low and close repeat the previous reading's in a run longer than the source's rate of
      repeats can explain (see `robust.repeat_limit`); the first reading of the run is none. Runs may be of any length.

    `score` is the greatest ratio of a deviation to its limit. Null or NaN values are no case by themselves and are passed
    over. Readings with the same source and time count once, the one with the greatest `version` holds, then the greatest values.
    Rows with a null time are ignored; null source columns form a source of their own. Extra columns don't matter. An
    empty table gives an empty result.
    """
    require(df, *source, time, *FIELDS)
    ship(df.sparkSession)
    keys, core = _readings(df, source, time, version, block_s)
    at = [*keys, "_block"]
    beside = halo(core, keys, "_t", HALO).unionByName(halo(core, keys, "_t", HALO, after=True))
    right = beside.unionByName(_normal(core, keys, max_price), allowMissingColumns=True)
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # other attributes than those of `core`

    def judge(left: pa.Table, other: pa.Table) -> pa.Table:
        return _judge(left, other, keys, half_window, half_scale, sigmas, max_price)

    kinds = dict(core.dtypes)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "_t bigint, impossible boolean, spike boolean, stuck boolean, score double"])
    found = core.groupBy(*at).cogroup(right.groupBy(*at)).applyInArrow(judge, schema)
    return found.select(*[F.col(k).alias(s) for s, k in zip(source, keys)], F.timestamp_micros("_t").alias(time),
                        "impossible", "spike", "stuck", "score")


_BAR = "struct<high:double,low:double,close:double>"
_SUMMARY = (f"_t bigint, _nruns bigint, _ac bigint, _ab {_BAR}, _zc bigint, _zb {_BAR}, _in_fresh bigint, _in_runs bigint, _in_n1 bigint, _in_n2 bigint, _in_n3 bigint, "
            "_first double, _end double, _counts array<struct<m:string,b:int,c:bigint>>")


def _summary(part: pa.Table, keys: list[str], max_price: float) -> pa.Table:
    """One row for a block: its first time, the runs of equal bars at its ends and the number of those inside, its first and last close, and counts of changes and spreads by bucket."""
    t = part.column("_t").to_numpy(zero_copy_only=False)
    order = np.argsort(t, kind="stable")
    bars = np.column_stack([_column(part, c)[order] for c in ("high", "low", "close")])
    close, spread = bars[:, 2], _column(part, "spread")[order]
    bars = bars[~np.isnan(bars).any(axis=1)]
    row: dict = dict.fromkeys(("_ac", "_ab", "_zc", "_zb", "_first", "_end")) | dict.fromkeys(("_nruns", "_in_fresh", "_in_runs", "_in_n1", "_in_n2", "_in_n3"), 0)
    if len(bars):
        starts = np.flatnonzero(np.concatenate(([True], (bars[1:] != bars[:-1]).any(axis=1))))
        size = np.diff(np.concatenate((starts, [len(bars)])))
        inside = size[1:-1]
        as_bar = lambda i: dict(zip(("high", "low", "close"), bars[i].tolist()))
        row |= {"_nruns": len(size), "_ac": int(size[0]), "_ab": as_bar(0), "_zc": int(size[-1]), "_zb": as_bar(-1), "_in_fresh": len(inside), "_in_runs": int((inside > 1).sum()),
                **{f"_in_n{n}": int((inside == n + 1).sum()) for n in (1, 2, 3)}}
    with np.errstate(invalid="ignore", divide="ignore"):
        ln = np.log(close[(close > 0) & (close < max_price)])
        change, spread = np.abs(np.diff(ln)), spread[spread >= 0]
    if len(ln):
        row |= {"_first": float(ln[0]), "_end": float(ln[-1])}
    counts = []
    for m, values in (("d", change[change > 0]), ("s", spread[spread > 0])):
        bucket, n = np.unique(np.ceil(np.log(values) / buckets.log_width(ERROR)).astype(int), return_counts=True)
        counts += [{"m": m, "b": int(i), "c": int(c)} for i, c in zip(bucket, n)]
    counts.append({"m": "0", "b": 0, "c": int((spread == 0).sum())})
    row |= {"_t": int(t.min()), "_counts": counts}
    kinds = [pa.field(k, part.schema.field(k).type) for k in (*keys, "_block")]
    bar = pa.struct([("high", pa.float64()), ("low", pa.float64()), ("close", pa.float64())])
    typed = {"_ab": bar, "_zb": bar, "_first": pa.float64(), "_end": pa.float64(), "_counts": pa.list_(pa.struct([("m", pa.string()), ("b", pa.int32()), ("c", pa.int64())]))}
    names = [x.split()[0] for x in _SUMMARY.split(", ")]
    arrays = [part.column(f.name).slice(0, 1).combine_chunks() for f in kinds] + [pa.array([row[n]], typed.get(n, pa.int64())) for n in names]
    return pa.table(arrays, schema=pa.schema([*kinds, *[pa.field(n, typed.get(n, pa.int64())) for n in names]]))


def _normal(core: DataFrame, keys: list[str], max_price: float) -> DataFrame:
    """What is normal for a source, as one row for each of its blocks, and how far the runs at the block's ends reach.

    `_move` is the median change of the logarithm of the close, of changes that aren't zero; `_s25`, `_s75` are quartiles of the spread; `_runs`, `_n1`, `_n2`, `_n3` and `_fresh` are the
    numbers of runs of repeats, of those of exactly one, two and three, and of readings that repeat none. `_head` and `_tail` are the numbers of readings of the whole
    runs that the block's first and last full readings belong to, `_linked` tells that the first one isn't the beginning of its run. Readings are passed over once, a block at a time; the
    rest works on one row per block.
    """
    at = [*keys, "_block"]
    kinds = dict(core.dtypes)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in at], _SUMMARY])
    # written once, as everything below reads it
    parts = cut_lineage(core.groupBy(*at).applyInArrow(lambda part: _summary(part, keys, max_price), schema))
    series = Window.partitionBy(*keys).orderBy("_block")
    so_far = series.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({
        "_linked": F.coalesce(F.col("_ab") == F.last("_zb", ignorenulls=True).over(so_far), F.lit(False)),
        "_cut": F.abs(F.col("_first") - F.last("_end", ignorenulls=True).over(so_far)),
    })
    # the runs at the ends of blocks: those that are one across a cut form an island
    end = lambda pos, c, new: F.struct(F.lit(pos).alias("pos"), F.col(c).alias("c"), new.alias("new"))
    ends = parts.where(F.col("_nruns") > 0).select(*at, "_linked", F.explode(F.filter(
        F.array(end(0, "_ac", ~F.col("_linked")), F.when(F.col("_nruns") > 1, end(1, "_zc", F.lit(True)))), lambda x: x.isNotNull())).alias("e")).select(*at, "_linked", "e.*")
    along = Window.partitionBy(*keys).orderBy("_block", "pos").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumn("_island", F.sum(F.col("new").cast("bigint")).over(along)).withColumn("_rows", F.sum("c").over(Window.partitionBy(*keys, "_island")))
    exact = lambda c, shift: [F.count_if(F.col("new") & (F.col(c) == n + shift)).alias(f"_n{n}") for n in (1, 2, 3)]
    counted = ends.groupBy(*keys).agg(F.count_if("new").alias("_fresh"), F.count_if(F.col("new") & (F.col("_rows") > 1)).alias("_runs"), *exact("_rows", 1))
    counted = counted.unionByName(parts.groupBy(*keys).agg(F.sum("_in_fresh").alias("_fresh"), F.sum("_in_runs").alias("_runs"), *[F.sum(f"_in_n{n}").alias(f"_n{n}") for n in (1, 2, 3)]))
    counted = counted.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("_fresh", "_runs", "_n1", "_n2", "_n3")])
    reach = ends.groupBy(*at).agg(F.max(F.when(F.col("pos") == 0, F.col("_rows"))).alias("_head"), F.max_by("_rows", "pos").alias("_tail"), F.max("_linked").alias("_linked"))
    # counts by bucket of all blocks, and the changes across cuts; the value of a rank is read from the running count
    across = F.ceil(F.log("_cut") / F.lit(buckets.log_width(ERROR))).cast("int")
    cuts = parts.where(F.col("_cut") > 0).select(*keys, F.lit("d").alias("m"), across.alias("b"), F.lit(1).cast("bigint").alias("c"))
    counts = parts.select(*keys, F.explode("_counts").alias("_x")).select(*keys, "_x.*").unionByName(cuts).where(F.col("c") > 0)
    counts = counts.groupBy(*keys, F.when(F.col("m") == "0", "s").otherwise(F.col("m")).alias("_m"), F.when(F.col("m") == "0", 0).otherwise(1).alias("sgn"), "b").agg(F.sum("c").alias("_c"))
    group = Window.partitionBy(*keys, "_m")
    upto = group.orderBy(buckets.order(F.col("sgn"), F.col("b"))).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumns({"_upto": F.sum("_c").over(upto), "_all": F.sum("_c").over(group), "_mid": buckets.middle(F.col("sgn"), F.col("b"), ERROR)})
    est = lambda m, p: F.min(F.when((F.col("_m") == m) & (F.floor(F.lit(p) * (F.col("_all") - 1)) < F.col("_upto")), F.col("_mid")))
    stats = ranked.groupBy(*keys).agg(est("d", 0.5).alias("_move"), est("s", 0.25).alias("_s25"), est("s", 0.75).alias("_s75"))
    blocks = parts.select(*at, "_t")
    for i, part in enumerate((stats, counted, reach)):
        names = keys + (["_block"] if "_block" in part.columns else [])
        named = part.select(*[F.col(k).alias(f"{k}n{i}") for k in names], *[c for c in part.columns if c not in names])
        blocks = blocks.join(named, same_keys(names, f"n{i}"), "left").drop(*[f"{k}n{i}" for k in names])
    return blocks.withColumn("_stats", F.lit(1.0))


def _column(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy(zero_copy_only=False).astype(float)


def _judge(left, other, keys, half, half_scale, sigmas, max_price) -> pa.Table:
    is_stats = _column(other, "_stats") == 1.0
    halo, stats = other.filter(pa.array(~is_stats)), other.filter(pa.array(is_stats))
    both = pa.concat_tables([left.select(["_t", *FIELDS]), halo.select(["_t", *FIELDS])])
    t = both.column("_t").to_numpy(zero_copy_only=False)
    order = np.argsort(t, kind="stable")
    mine = (np.arange(len(t)) < left.num_rows)[order]
    high, low, close, spread = (_column(both, c)[order] for c in FIELDS)
    one = lambda c: next((v for v in stats.column(c).to_pylist() if v is not None), 0) if stats.num_rows else 0
    with np.errstate(all="ignore"):
        prices = (high, low, close)
        impossible = (high < low) | (close > high) | (close < low) | (spread < 0)
        for x in prices:
            impossible |= (x <= 0) | (x >= max_price)
        score = np.zeros(len(t))
        spike = np.zeros(len(t), bool)
        fields = [(np.log(np.where((x > 0) & (x < max_price), x, np.nan)), one("_move") or np.inf) for x in prices]
        fields.append((np.where(spread >= 0, spread, np.nan), max(1.0, (one("_s75") - one("_s25")) / 2)))
        for y, least in fields:
            dev, scale = robust.hampel_of_changes(y, half, half_scale)
            ratio = np.nan_to_num(np.abs(dev) / (sigmas * robust.MAD_TO_SIGMA * np.maximum(scale, least)))
            score, spike = np.maximum(score, ratio), spike | robust.comes_back(y, ratio > 1, dev, 5, half)
    limit = robust.repeat_limit(one("_fresh"), one("_runs"), one("_n1"), one("_n2"), one("_n3"))
    stuck = np.zeros(len(t), bool)
    own = np.column_stack([x[mine] for x in prices])
    stuck[mine] = robust.long_repeats(own, limit, one("_head"), one("_tail"), bool(one("_linked")))
    hit = (impossible | spike | stuck) & mine
    n = int(hit.sum())
    named = {k: pa.repeat(left.column(k)[0], n) if n else left.column(k).slice(0, 0).combine_chunks() for k in keys}
    return pa.table({**named, "_t": pa.array(t[order][hit], pa.int64()), "impossible": impossible[hit], "spike": spike[hit],
                     "stuck": stuck[hit], "score": score[hit]})
