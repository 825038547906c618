import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.llm import endings, truncation

SCHEMA = "doc_id bigint, text string, source string, p_cut string, closed int"


@pytest.mark.parametrize("text,want", [
    ("He came home.", True), ('He said, "No."  ', True), ("« Il vient. »\n", True), ("Is it so? ·", True), ("in the opinion of Mr.", False), ("told by Dr. ", False), ("he came", False),
    ("he came...", False), ("he ca…", False), ("", False), ("KELVERTON, 17.", False), ("it cost l7l.", True), ("No. 7.", False),
])
def test_finished(text, want):
    assert endings.finished(text) is want


@pytest.mark.parametrize("text,want", [("prose goes on\n* * *", True), ("prose\n———  ", True), ("prose\n--", False), ("* * *", False), ("he went to\n....", False), ("", False)])
def test_ornament(text, want):
    assert endings.ornament(text) is want


@pytest.mark.parametrize("pad", [" " * 3000, "\n" * 2500, "|" * 2500, " ·" * 1500])
def test_long_padding_hides_no_ending(pad):
    cut, whole = "the bridge was old\nand the coun", "the bridge was old"
    assert not endings.closed(cut + pad) and endings.features(cut + pad).tolist() == endings.features(cut).tolist()
    assert endings.closed(whole + "." + pad) and endings.ornament(whole + "\n———" + " " * 3000)


def test_lines_of_any_length():
    words = [f"w{i}" for i in range(100_000)]
    got = endings.last_lines(" ".join(words))
    assert len(got) == endings.LINES and " ".join(got).split() == words[-endings.LINES * endings.LINE_WORDS:]
    assert endings.last_lines("a b\nc\n") == ["a b", "c", ""] and endings.last_lines("") == [""]
    assert len(endings.features("x" * 300_000)) > 0 and len(endings.features("")) > 0


def test_places_are_inside_prose():
    prose = "The council of the town has met again today.\nNothing was said about the bridge at all there.\nIt was then agreed to repair the old harbour."
    advert = "\nBOOTS AND SHOES\nhalf price\nSmith and Sons\nthe old Arcade\nCash only here\nDoors open nine\nTickets inside\nNo children now\nBring the coupon"
    text, rng = f"{prose}{advert}\n{prose}\n{prose}", np.random.default_rng(1)
    places = endings.prose_places(text, rng, 200, 8)
    assert len(places) > 20 and not [p for p in places if len(prose) < p <= len(prose + advert)]
    assert endings.prose_places("short.", rng, 2) == [] and endings.prose_places("no end of a sentence " * 20, rng, 2) == []


def test_block_size():
    rng = np.random.default_rng(2)
    whole, cut = rng.integers(200, 9000, 20_000), rng.integers(1, 30, 300) * 256
    lengths = np.concatenate((whole, cut))
    counts = {b: (float((lengths % b == 0).sum()), len(lengths) / b) for b in truncation.BLOCKS}
    size, share = truncation.block_size(counts, len(lengths))
    assert size == 256 and abs(share - 300 / (300 + 20_000 / 256)) < 0.1
    assert truncation.block_size({b: (float((whole % b == 0).sum()), len(whole) / b) for b in truncation.BLOCKS}, len(whole)) is None and truncation.block_size({}, 0) is None


def test_folding_joins_misread_words():
    assert endings.fold("Continued") == endings.fold("C0ntinued") == endings.fold("Continned") and endings.fold("modern") == endings.fold("modem")


def test_censored_fit_finds_the_parameters():
    rng = np.random.default_rng(3)
    x = np.maximum(1, rng.lognormal(7.5, 0.6, 40_000)).astype(int)
    cut = rng.random(len(x)) < 0.5
    seen = np.where(cut & (x > 3000), 3000, x)
    v, n = np.unique(seen, return_counts=True)
    limits = truncation.candidate_limits(v, n)
    assert limits == [(3000, 3000)]
    mu, sd, share = truncation.fit_censored(v, n, limits)
    # half of the texts aren't limited, so the plain distribution lies between the two
    assert abs(mu - 7.5) < 0.03 and abs(sd - 0.6) < 0.05 and share[0] > 0.98
    naive = np.log(seen)
    assert abs(mu - 7.5) < abs(naive.mean() - 7.5)


def test_no_limits_in_smooth_lengths_and_edges():
    rng = np.random.default_rng(3)
    v, n = np.unique(rng.lognormal(7.5, 0.6, 20_000).astype(int), return_counts=True)
    assert truncation.candidate_limits(v, n) == []
    assert truncation.candidate_limits(np.zeros(0, int), np.zeros(0, int)) == []
    assert len(truncation.limits_of_source(pd.DataFrame({"_src": "s", "unit": "chars", "length": v, "n": n, "cut": 0.0}))) == 0


def test_piles_of_forms_are_no_limits():
    hist = pd.DataFrame({"_src": "s", "unit": "chars", "length": [80, 500, 900, 1300], "n": [40, 3, 2, 1], "cut": [0.0, 0.2, 0.1, 0.1]})
    got = truncation.limits_of_source(hist)
    assert (got["limit"] == 80).all() and (got["censored"] < 0.05).all()


def test_likelihood_curve_rises():
    rng = np.random.default_rng(1)
    whole, cut = rng.normal(-4, 1.5, 2000), rng.normal(4, 1.5, 200)
    at, ratio, share = endings.likelihood_curve(np.concatenate((whole, cut)), rng.normal(4, 1.5, 1000))
    assert (np.diff(ratio) >= 0).all() and abs(share - 200 / 2200) < 0.01 and abs(np.interp(0, at, ratio)) < 1.0
    assert endings.likelihood_curve(whole[:3], cut[:3])[2] == 0.05


def test_share_and_curve_are_those_of_all_texts(spark):
    rng = np.random.default_rng(5)
    z = np.concatenate((rng.normal(-4, 1.5, 6000), rng.normal(4, 1.5, 2000)))
    first = endings.likelihood_curve(z[:6100], rng.normal(4, 1.5, 1000))
    seen = endings.Evidence((None, None), first[:2], first[2], rng.normal(4, 1.5, 1000))
    scored = spark.createDataFrame(pd.DataFrame({"closed": False, "score": z})).unionByName(spark.sql("SELECT true AS closed, double('nan') AS score FROM range(500)"))
    curve, share = truncation._of_all(scored, seen)
    assert seen.share < 0.03 and abs(share - 0.25) < 0.01
    want = endings.likelihood_curve(z, seen.cuts)
    assert np.allclose(curve[1], want[1], atol=0.02) and abs(share - want[2]) < 1e-3
    at = np.array([-20, -12, -0.13, 0.0, 3.3, 12, 20])
    got = [r[0] for r in spark.createDataFrame([(float(v),) for v in at], "z double").select(truncation._along(F.col("z"), *curve)).collect()]
    assert np.allclose(got, np.interp(at, *curve))


@pytest.fixture
def first_curve(monkeypatch):
    """Evidence of a sample that saw hardly any cut texts."""
    learn = endings.learn

    def poor(*args, **kw):
        found = learn(*args, **kw)
        found.share = 1e-4
        return found

    monkeypatch.setattr(endings, "learn", poor)


def test_the_share_of_the_sample_decides_nothing(spark, corpus, first_curve):
    df, cut = corpus
    got = truncation.truncated(df)[0].toPandas()
    found = set(got[got.p_cut > 0.5].doc_id)
    assert len(found & cut) / len(cut) > 0.93 and len(found & cut) / len(found) > 0.93


WORDS = "the council of a small town was asked to repair its old bridge near harbour before winter and Smith has said that cost would be high for many people who live there".split()


def text_of(rng, n):
    out = []
    while sum(map(len, out)) < n:
        s = " ".join(rng.choice(WORDS) for _ in range(rng.randint(6, 14)))
        out.append(s[0].upper() + s[1:] + ".")
    flat, lines, line = " ".join(out), [], ""
    for w in flat.split():
        if len(line) + len(w) > 45:
            lines.append(line)
            line = w
        else:
            line = f"{line} {w}".strip()
    return "\n".join([*lines, line])


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(8)
    rows, cut = [], set()
    for i in range(1500):
        t = text_of(rng, int(rng.lognormvariate(6.8, 0.5)))
        source = ["a", "b", None][i % 3]
        if source == "a" and len(t) > 1000:
            t = t[:1000]
        elif rng.random() < 0.06 and len(t) > 200:
            t = t[:rng.randint(150, len(t) - 20)] + rng.choice(["", "   ", "..."])
        elif rng.random() < 0.2:
            t += rng.choice(["\nContinued on page 7", "\n* * *", "\n—J. Brown", "\nA RATEPAYER"])
        if not t.endswith(("7", "*", "Brown", "PAYER")) and not (t.endswith(".") and not t.endswith("...")):
            cut.add(i)
        rows.append((i, t, source, "clash", 1))
    rows += [(9001, None, "a", "", 1), (9002, "", "a", "", 1), (9003, " \n ", None, "", 1), (9004, "Long text. " * 200_000, "b", "", 1), (5, "Twice here.", "b", "", 1)]
    return spark.createDataFrame(rows, SCHEMA), cut


def test_held_out_accuracy(spark, corpus):
    df, cut = corpus
    scores, limits = truncation.truncated(df)
    got = scores.toPandas()
    assert len(got) == 1502 and not set(got.doc_id) & {9001, 9002, 9003}
    found = set(got[got.p_cut > 0.5].doc_id)
    assert len(found & cut) / len(cut) > 0.93 and len(found & cut) / len(found) > 0.93
    assert got[got.closed].p_cut.max() == 0 and got.p_cut.between(0, 1).all()
    lim = limits.where("source = 'a' AND unit = 'chars' AND limit = 1000").first()
    assert lim["censored"] > 0.8 and lim["at_limit"] > 100
    report = {r["source"]: r for r in truncation.truncation_report(scores).collect()}
    assert set(report) == {"a", "b", None} and sum(r["n_texts"] for r in report.values()) == 1502 and report["a"]["share_cut"] > report["b"]["share_cut"]
    again = truncation.truncated(df)[0].toPandas()
    assert math.isclose(again.p_cut.sum(), got.p_cut.sum())


def test_lengths_decide_where_endings_dont(spark):
    """Cut endings at a limit are found with the lengths and missed without, most of all those that look like the signatures of other texts."""
    rng, rows, cut = random.Random(11), [], set()
    for i in range(1600):
        t = text_of(rng, int(rng.lognormvariate(6.6, 0.6)))
        if i % 4 == 0:
            t = text_of(rng, 2400)[:1200 - 6] + "\nSmith" if i % 80 == 0 else text_of(rng, 2400)[:1200]
            t = t[:-1] + "e" if t.endswith((".", " ", "\n")) else t
            cut.add(i)
        elif i % 80 == 1:
            t += "\nSmith"
        rows.append((i, t, "a", "clash", 1))
    df = spark.createDataFrame(rows, SCHEMA)
    found = [{r["doc_id"] for r in truncation.truncated(df, use_lengths=u)[0].where("p_cut > 0.5").select("doc_id").collect()} for u in (True, False)]
    planted = {i for i in cut if i % 80 == 0}
    assert len(found[0] & cut) / len(cut) > 0.95 and len(found[0] & cut) / len(found[0]) > 0.95
    assert len(found[1] & cut) < 0.9 * len(found[0] & cut) and len(found[0] & planted) > len(found[1] & planted) + 3


def test_empty_and_tiny(spark, corpus):
    df, _ = corpus
    scores, limits = truncation.truncated(df.limit(0))
    assert scores.count() == 0 and limits.count() == 0
    few = spark.createDataFrame([(1, "One whole sentence.", "a", "", 1), (2, "and then he", None, "", 1), (None, None, None, "", 1)], SCHEMA)
    assert truncation.truncated(few)[0].count() == 2
