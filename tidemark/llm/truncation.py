"""Texts cut off by field limits or in transfer.

The lengths of every source are fitted with a right-censored distribution whose candidate limits show as piles of equal lengths, and all of them are searched for a
block size of transfers, of which cut texts are whole multiples. That gives each text the chance that it was cut, by its length (`censored`). With it the
classifier of endings is taught which texts are whole (see `endings`), and with it the likelihood ratio of an ending becomes a posterior. Per text, only its
id, source, lengths and score go beyond the stage that reads texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import endings
from tidemark.session import cut_lineage, ship

NO_SOURCE = "\0none"
BINS = 256  # of a score, in the histogram of all open endings
WINDOW = 12  # lengths below a limit at which texts cut back to a word's end still pile up
LIMITS = "_src string, unit string, length bigint, limit bigint, at_limit bigint, censored double, mu double, sigma double"


# -- lengths

def _phi(x):
    return np.exp(-0.5 * np.asarray(x) ** 2) / math.sqrt(2 * math.pi)


def _cdf(x):
    return 0.5 * np.vectorize(math.erfc, otypes=[float])(-np.asarray(x, float) / math.sqrt(2))


def candidate_limits(length: np.ndarray, count: np.ndarray, window: int = WINDOW, reach: int = 200, least: int = 5) -> list[tuple[int, int]]:
    """Piles in a histogram of lengths: (limit, lowest length that belongs to it), the highest pile first.

    A pile is a length up to which, within `window`, there are at least `least` texts and far more than the neighbourhood of
    `reach` lengths on either side lets expect.
    """
    if not len(length):
        return []
    total = np.concatenate(([0], np.cumsum(count)))
    upto = lambda v: total[np.searchsorted(length, v, side="right")]
    own = upto(length) - upto(length - window)
    around = upto(length + reach) - upto(length) + upto(length - window) - upto(length - window - reach)
    usual = around * window / (2.0 * reach)
    excess = own - usual
    good = (own >= least) & (excess > 5 * np.sqrt(usual + 1))
    found: list[tuple[int, int]] = []
    for i in np.argsort(-excess, kind="stable"):
        at = int(length[i])
        if good[i] and all(abs(at - limit) > window for limit, _ in found):
            inside = (length > at - window) & (length <= at)
            # the pile itself: nearly all of it, without single lengths at its edges
            order = np.flatnonzero(inside)[::-1]
            run = np.cumsum(count[order])
            first = np.searchsorted(run, 0.03 * own[i], side="right")
            last = np.searchsorted(run, 0.97 * own[i])
            found.append((int(length[order[first]]), int(length[order[max(first, last)]])))
    return found


def fit_censored(length: np.ndarray, count: np.ndarray, limits: list[tuple[int, int]], rounds: int = 60) -> tuple[float, float, list[float]]:
    """Maximum likelihood of a log-normal length distribution in which texts in the piles are, with the chance to be found, cut at the limit.

    Returns mu, sigma and for each pile the share of its texts that were cut. By expectation maximisation: a cut text counts with the
    moments of the part of the distribution above its limit.
    """
    x, c = np.log(np.maximum(length, 1).astype(float)), count.astype(float)
    n, mine = c.sum(), [(length >= low) & (length <= top) for top, low in limits]
    mu, sd = np.average(x, weights=c), max(0.05, math.sqrt(np.average((x - np.average(x, weights=c)) ** 2, weights=c)))
    share = [1.0] * len(limits)
    for _ in range(rounds):
        w, extra = c.copy(), []
        for k, ((top, low), at) in enumerate(zip(limits, mine)):
            a, b = (np.log([low - 0.5 if low > 1 else 0.5, top + 0.5]) - mu) / sd
            whole = n * float(_cdf(b) - _cdf(a))
            here = c[at].sum()
            share[k] = float(np.clip(1 - whole / here, 0.0, 0.999)) if here else 0.0
            w[at] *= 1 - share[k]
            t = (math.log(top) - mu) / sd
            tail = max(1e-12, 1 - float(_cdf(t)))
            h = float(_phi(t)) / tail
            first = mu + sd * h
            second = sd * sd * (1 + t * h - h * h) + first * first
            extra.append((here * share[k], first, max(second, first * first)))
        total = w.sum() + sum(e[0] for e in extra)
        m1 = ((w * x).sum() + sum(e[0] * e[1] for e in extra)) / total
        m2 = ((w * x * x).sum() + sum(e[0] * e[2] for e in extra)) / total
        moved = abs(m1 - mu)
        mu, sd = float(m1), max(0.05, math.sqrt(max(m2 - m1 * m1, 0.0)))
        if moved < 1e-7:
            break
    return mu, sd, share


def limits_of_source(hist: pd.DataFrame) -> pd.DataFrame:
    """From one source's histogram (columns _src, unit, length, n, cut): each length in a pile with the chance that a text of it was cut.

    `cut` is the number of texts of that length that are cut by their endings alone. A pile can't have more cut texts than both its
    excess over the fitted distribution and its endings allow: short texts made from one form have equal lengths too.
    """
    out = []
    for unit, part in hist.groupby("unit"):
        part = part.sort_values("length")
        length, count = part["length"].to_numpy(np.int64), part["n"].to_numpy(np.int64)
        limits = candidate_limits(length, count)
        if not limits:
            continue
        mu, sd, share = fit_censored(length, count, limits)
        ending = part["cut"].to_numpy(float)
        for (top, low), r in zip(limits, share):
            inside = (length >= low) & (length <= top)
            r = min(r, (ending[inside].sum() + 0.5) / (count[inside].sum() + 1))
            out += [(hist["_src"].iloc[0], unit, int(v), top, int(count[inside].sum()), r, mu, sd) for v in length[inside]]
    return pd.DataFrame(out, columns=["_src", "unit", "length", "limit", "at_limit", "censored", "mu", "sigma"])


BLOCKS = [1 << k for k in range(6, 17)]


def block_size(counts: dict[int, tuple[float, float]], n: float) -> tuple[int, float] | None:
    """The size of transfer blocks and the share of texts at a multiple of it that were cut there, or None.

    `counts` has, by size, how many of `n` texts end at a multiple and how many would by chance. The size with the most significant excess holds:
    half of it has the same excess among twice as many by chance, the double has half of the excess.
    """
    signal = {b: (seen - chance) / math.sqrt(chance + 1) for b, (seen, chance) in counts.items()}
    best = max(signal, key=lambda b: (signal[b], b), default=None)
    if best is None or signal[best] < 5:
        return None
    seen, chance = counts[best]
    return best, min(0.999, (seen - chance) / seen)


# -- the whole

def _lengths(rows: DataFrame, **sums: Column) -> DataFrame:
    """Histogram of both lengths by source."""
    long = rows.select("_src", *[c.alias(n) for n, c in sums.items()], F.explode(F.array(
        F.struct(F.lit("chars").alias("unit"), F.col("n_chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("n_bytes").alias("length"))
    )).alias("_l"))
    return long.groupBy("_src", F.col("_l.unit").alias("unit"), F.col("_l.length").alias("length")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(n).alias(n) for n in sums])


def _piles(hist: DataFrame) -> DataFrame:
    return cut_lineage(hist.groupBy("_src").applyInPandas(limits_of_source, LIMITS))


def _with_censoring(rows: DataFrame, piles: DataFrame) -> DataFrame:
    """Add `censored`: the chance to have been cut at a limit of its source, 0 for lengths in no pile."""
    for unit, length in (("chars", "n_chars"), ("bytes", "n_bytes")):
        part = piles.where(F.col("unit") == unit).select(F.col("_src").alias(f"_{unit}s"), F.col("length").alias(f"_{unit}"), F.col("censored").alias(f"_{unit}c"))
        rows = rows.join(part, (F.col("_src") == F.col(f"_{unit}s")) & (F.col(length) == F.col(f"_{unit}")), "left").drop(f"_{unit}s", f"_{unit}")
    zero = F.lit(0.0)
    return rows.withColumn("censored", F.greatest(F.coalesce("_charsc", zero), F.coalesce("_bytesc", zero))).drop("_charsc", "_bytesc")


def _training_rows(docs: DataFrame, n: int, piles: DataFrame, sample: int, cuts: int) -> pd.DataFrame:
    """Features of about `sample` of the `n` texts as they are and of each cut at `cuts` random places; only features come to the driver."""
    keep = docs.where(F.pmod(F.xxhash64("_hash", F.lit(7)), F.lit(1 << 20)) < F.lit(int(min(1.0, sample / max(n, 1)) * (1 << 20))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for h, c, t in zip(b["_hash"], b["censored"], b["text"]):
                rows.append((h, 0, c, endings.closed(t), endings.features(t).tolist()))
                rng = np.random.default_rng(xxhash.xxh64_intdigest(t))
                rows += [(h, k, 0.0, endings.closed(t[:p]), endings.features(t[:p]).tolist()) for k, p in enumerate(endings.prose_places(t, rng, cuts), 1)]
            yield pd.DataFrame(rows, columns=["h", "k", "c", "done", "f"])

    marked = _with_censoring(keep, piles).select("_hash", "censored", "text")
    found = marked.mapInPandas(run, "h bigint, k int, c double, done boolean, f array<int>").toPandas()
    most = found.loc[found.k == 0].nsmallest(sample, "h")["h"] if len(found) else found["h"]
    return found[found.h.isin(set(most))].sort_values(["h", "k", "c"]).reset_index(drop=True)


def _score_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Histogram of the scores of open endings, which comes to the driver: at most `BINS` bins for each unit of score."""
    bins = rows.where(~F.col("closed")).groupBy(F.round(F.col("score") * BINS).try_cast("bigint").alias("_b")).agg(F.count(F.lit(1)).alias("n"))
    hist = bins.toPandas().sort_values("_b")
    return hist["_b"].to_numpy(float) / BINS, hist["n"].to_numpy(float)


def _of_all(scored: DataFrame, evidence: endings.Evidence) -> tuple[tuple[np.ndarray, np.ndarray], float]:
    """The curve and the share of cut ones among open endings, from the scores of all texts."""
    score, n = _score_counts(scored)
    *curve, share = endings.likelihood_curve(score, evidence.cuts, n)
    return tuple(curve), share


def _along(score: Column, at: np.ndarray, value: np.ndarray) -> Column:
    """Linear interpolation between evenly spaced points; beyond them the values at the ends."""
    step = float(at[1] - at[0])
    place = (F.greatest(F.least(score, F.lit(float(at[-1]))), F.lit(float(at[0]))) - F.lit(float(at[0]))) / F.lit(step)
    i = F.least(F.floor(place), F.lit(len(at) - 2)).cast("int")
    values = F.array(*[F.lit(float(v)) for v in value])
    low, high = F.get(values, i), F.get(values, i + 1)
    return low + (high - low) * (place - i)


def _at_block(size: int) -> Column:
    """A multiple of the size lies between the text's bytes without and with the marks behind it."""
    return (F.floor(F.col("n_bytes") / F.lit(size)) * F.lit(size) >= F.greatest(F.col("_bare"), F.lit(1))) & (F.col("n_bytes") >= size)


def _blocks(rows: DataFrame) -> tuple[int, float] | None:
    """The block size among texts that are in no pile; a row of counts comes to the driver."""
    by_chance = lambda b: F.sum(F.when(F.col("n_bytes") >= b, F.least(F.lit(1.0), (F.col("n_bytes") - F.col("_bare") + 1) / F.lit(float(b)))))
    wanted = [x for b in BLOCKS for x in (F.count_if(_at_block(b)).alias(f"seen{b}"), by_chance(b).alias(f"chance{b}"))]
    got = rows.where(F.col("censored") == 0).agg(F.count(F.lit(1)).alias("n"), *wanted).first()
    return block_size({b: (float(got[f"seen{b}"]), float(got[f"chance{b}"] or 0.0)) for b in BLOCKS}, got["n"])


def truncated(
    docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", sample: int = 14_000, cuts: int = 2, use_lengths: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """The chance of every text to be cut off, and the limits of every source.

    Returns (scores, limits). `scores` has one row per text that isn't null or blank: id, source, `n_chars`, `n_bytes`, `at_limit` (its
    length is in a pile or at a block), `censored` (chance to be cut, by length), `closed` (ends with a sentence or an ornament), `log_ratio` of the ending evidence and `p_cut`. Closed
    texts have `p_cut` 0. `limits` has one row per source and limit: `unit` (chars or bytes), `limit`, `at_limit`, the share of them that
    is `censored`, and the fitted `mu` and `sigma` of the logarithm of length; a size of transfer blocks is a row of unit `block` without a source.

    The classifier is fitted on at most `sample` texts; everything else covers all of them, also the curve and the share of cut ones that its scores
    are read with. `use_lengths` False leaves the censoring out, to show what it decides. Null sources form a source of their own. Rows
    with the same id are separate texts. Null, empty and blank texts aren't in the result; texts of any length are read whole. Extra columns are ignored. Empty tables give empty results.
    """
    ship(docs.sparkSession)
    named = docs.select(
        F.col(id).alias("_id"), F.col(source).alias("_source"), F.coalesce(F.col(source), F.lit(NO_SOURCE)).alias("_src"), F.col(text).alias("text"),
        F.xxhash64(F.col(id), F.length(text)).alias("_hash"), F.length(text).cast("bigint").alias("n_chars"), F.octet_length(text).cast("bigint").alias("n_bytes"),
    ).where(F.col("text").rlike(r"[^\s\u00a0]"))
    # Every text might be cut as far as its ending goes, which hasn't been read yet.
    first = cut_lineage(_lengths(named).withColumn("cut", F.col("n").cast("double")))
    n = first.where("unit = 'chars'").agg(F.sum("n")).first()[0] or 0
    train = _training_rows(named, n, _piles(first.where(F.lit(use_lengths))), sample, cuts)
    rows = [np.asarray(f, np.int32) for f in train.pop("f")]
    cut, half = (train["k"].to_numpy() > 0).astype(int), (train["h"].to_numpy() & 1).astype(int)
    evidence = endings.learn(rows, cut, half, train["done"].to_numpy(bool), train["c"].to_numpy(float))
    del rows, train
    shared = docs.sparkSession.sparkContext.broadcast(evidence)  # two vectors of endings.SIZE

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = shared.value
        for b in batches:
            closed = np.fromiter((endings.closed(t) for t in b["text"]), bool, len(b))
            score = np.full(len(b), np.nan)
            open_ = np.flatnonzero(~closed)
            feats = [endings.features(b["text"].iloc[i]) for i in open_]
            score[open_] = e.scores(feats, (b["_hash"].to_numpy()[open_] & 1).astype(int))
            bare = [len(endings.bare(t)[0].encode("utf-8", "surrogatepass")) for t in b["text"]]
            yield b[["_id", "_source", "_src", "n_chars", "n_bytes"]].assign(_bare=bare, closed=closed, score=score)

    kind = dict(named.dtypes)["_id"]
    scored = cut_lineage(named.mapInPandas(score, f"_id {kind}, _source string, _src string, n_chars bigint, n_bytes bigint, _bare bigint, closed boolean, score double"))
    curve, share = _of_all(scored, evidence)
    scored = scored.withColumn("log_ratio", F.when(F.col("closed"), F.lit(-8.0)).otherwise(_along(F.col("score"), *curve)))
    chance = lambda odds: 1 / (1 + F.exp(-odds))
    by_ending = lambda share: F.when(F.col("closed"), F.lit(0.0)).otherwise(chance(F.col("log_ratio") + float(endings.odds(share))))
    piles = _piles(_lengths(scored.where(F.lit(use_lengths)), cut=by_ending(share)))
    marked = _with_censoring(scored, piles)
    block = _blocks(marked) if use_lengths and n else None
    if block:
        marked = marked.withColumn("censored", F.when((F.col("censored") == 0) & _at_block(block[0]), F.lit(block[1])).otherwise(F.col("censored")))
    # Cut ones among open endings of all other lengths: their share in all sources, and that of a source drawn to it.
    away = marked.where(F.col("censored") == 0)
    scores, counts = _score_counts(away)
    elsewhere = endings.share_of_cut(np.interp(scores, *curve), counts, share)
    shares = away.where(~F.col("closed")).groupBy(F.col("_src").alias("_shs")).agg(
        ((F.sum(by_ending(elsewhere)) + 20 * elsewhere) / (F.count(F.lit(1)) + 20)).alias("_share")
    )
    # The chance by length is about all texts. Among whole texts only some end openly, which raises the odds of those that do.
    total = scored.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("closed")).alias("o")).first()
    whole_open = max(1e-3, (total["o"] * (1 - share)) / max(1, total["n"] - total["o"] * share))
    odds = lambda p: F.log(p / (1 - p))
    bounded = lambda c, low: F.least(F.greatest(c, F.lit(low)), F.lit(0.999))
    by_length = odds(bounded(F.col("censored"), 1e-6)) - math.log(whole_open)
    by_source = odds(bounded(F.coalesce("_share", F.lit(elsewhere)), 1e-4))
    prior = F.when(F.col("censored") > 0, F.greatest(by_length, by_source)).otherwise(by_source)
    p = F.when(F.col("closed"), F.lit(0.0)).otherwise(chance(prior + F.col("log_ratio")))
    joined = marked.join(shares, F.col("_src") == F.col("_shs"), "left")
    result = joined.select(
        F.col("_id").alias(id), F.col("_source").alias(source), "n_chars", "n_bytes", (F.col("censored") > 0).alias("at_limit"), "censored", "closed", "log_ratio", p.alias("p_cut")
    )
    limits = piles.groupBy(F.when(F.col("_src") != NO_SOURCE, F.col("_src")).alias("source"), "unit", "limit").agg(
        *[F.max(c).alias(c) for c in ("at_limit", "censored", "mu", "sigma")]
    )
    if block:
        found = marked.where(_at_block(block[0]) & (F.col("censored") == block[1])).agg(F.count(F.lit(1)).alias("at_limit"))
        none = F.lit(None).cast("double")
        limits = limits.unionByName(found.select(
            F.lit(None).cast("string").alias("source"), F.lit("block").alias("unit"), F.lit(block[0]).cast("bigint").alias("limit"), "at_limit", F.lit(block[1]).alias("censored"),
            none.alias("mu"), none.alias("sigma")))
    return result, limits


def truncation_report(scores: DataFrame, source: str = "source", least: float = 0.5) -> DataFrame:
    """Texts and cut ones by source."""
    return scores.groupBy(source).agg(
        F.count(F.lit(1)).alias("n_texts"), F.count_if(F.col("p_cut") > least).alias("n_cut"), F.avg((F.col("p_cut") > least).cast("double")).alias("share_cut")
    )
