"""How a text ends: features of its last lines and a classifier that labels itself.

Texts cut at random places in running prose are examples of cut endings; the texts as they are stand for whole endings, each as far as its length and
its ending speak for that. Two models are fitted on two halves of a bounded sample, and each text is judged by
the model that hasn't seen it. No list of words is used: what an advert, a notice or a signature looks like is learnt from the texts.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import xxhash

BITS = 17
SIZE = 1 << BITS
LINES, LINE_WORDS = 6, 12  # an ending is a text's last lines; a longer line counts as several
FILLED = 0.65  # share of the usual width from which a line counts as filled
REACH = 160  # characters within which running prose has the end of a sentence
LOWEST, POINTS = -12.0, 97  # scores at which the curve of likelihood ratios is kept
# Signs that a cut or the scanner leaves behind the last word (fixed values).
_MARKS = "".join(filter(str.isspace, map(chr, range(0x3001)))) + "…�|·•°¦`´'[]<>^~*_"
HYPHENS = ("-", "=", "~", "¬")
_DOTS = re.compile(r"(?<=[^\s.])\s?\.\.\.$")
_STOP = re.compile(r"[.!?][\"”“»'’)\]]*$|[.!?]\s[»“”\"]$")
_INNER_STOP = re.compile(r"(?:(?<=[^\W\d_]{4})|(?<=[\"”“»'’)\]]))[.!?](?=[\s\"”“»'’)\]])")
# A point behind a number or a short capitalised word may belong to an abbreviation, an initial or a day.
_UNSURE = re.compile(r"(?:^|[\s(\"“„«])(?:[A-ZÀ-Þ][a-zß-ÿ]{0,2}|\d+)\.$")
# Letters and pairs that readers of old print confuse; each group is folded to one sign (fixed values).
_PAIRS = (("rn", "m"), ("vv", "w"), ("cl", "d"), ("ii", "n"))
_FOLD = str.maketrans({**dict.fromkeys("0acoeàâäéèêö", "o"), **dict.fromkeys("fſt5ß", "s"), **dict.fromkeys("1i|j", "l"), **dict.fromkeys("b8", "h"),
                       **dict.fromkeys("uü", "n"), "y": "v", "9": "9"})


def bare(text: str) -> tuple[str, bool]:
    """The text without blanks and marks at its end, and whether a mark of omission was among them."""
    t = text.rstrip(_MARKS)
    dots = _DOTS.search(t, max(0, len(t) - 5))
    if dots:
        return t[:dots.start()].rstrip(_MARKS), True
    return t, "…" in text[len(t):] or "�" in text[len(t):]


def finished(text: str) -> bool:
    """Ends with a sentence's end that can't be the point of a short form or of a number."""
    t, omitted = bare(text)
    return not omitted and bool(_STOP.search(t)) and not _UNSURE.search(t)


def ornament(text: str) -> bool:
    """Ends with a line of its own of at least three strokes, stars or spaced points."""
    last = text.rstrip().rsplit("\n", 1)[-1].strip(" |·•°¦`´'")
    strokes = sum(c in "*—–-._=~#" for c in last)
    return "\n" in text.rstrip() and strokes >= 3 and not any(c.isalnum() for c in last) and last not in ("...", "....")


def closed(text: str) -> bool:
    """Whole by its last signs alone; every other ending is judged by the model."""
    return finished(text) or ornament(text)


def fold(word: str) -> str:
    w = word.lower()
    for a, b in _PAIRS:
        w = w.replace(a, b)
    return w.translate(_FOLD)


def last_lines(text: str) -> list[str]:
    """The last lines, in order; of a line of many words, stretches of a line's size, counted from its end."""
    out: list[str] = []
    for line in reversed(text.rsplit("\n", LINES)):
        words = line.split()
        if len(words) <= 2 * LINE_WORDS:
            out.append(line.strip())
        else:
            out += [" ".join(words[max(0, at - LINE_WORDS):at]) for at in range(len(words), max(0, len(words) - LINES * LINE_WORDS), -LINE_WORDS)]
        if len(out) >= LINES:
            break
    return out[:LINES][::-1]


def prose_places(text: str, rng: np.random.Generator, n: int, tries: int = 8) -> list[int]:
    """Up to `n` random places inside running prose: with a sentence's end not far before and not far behind, and only filled lines between these.

    Adverts, lists and headings lack the one or the other, so a text cut there would be no example of prose that stops too early.
    """
    if len(text) <= 120:
        return []
    stops = np.fromiter((m.end() for m in _INNER_STOP.finditer(text)), np.int64)
    if len(stops) < 2:
        return []
    breaks = np.fromiter((i for i, c in enumerate(text) if c == "\n"), np.int64)
    length = np.diff(np.concatenate(([-1], breaks, [len(text)]))) - 1
    full = FILLED * np.quantile(length, 0.8)
    at = rng.integers(60, len(text) - 1, n * tries)
    i = np.searchsorted(stops, at)
    inside = (i > 0) & (i < len(stops))
    i = np.clip(i, 1, len(stops) - 1)
    a, b = stops[i - 1], stops[i]
    good = inside & (at - a <= REACH) & (b - at <= REACH)
    first, last = np.searchsorted(breaks, a), np.searchsorted(breaks, b)  # lines in which the sentence begins and ends
    out = [int(p) for p, k, m, ok in zip(at, first, last, good) if ok and (length[k:m] >= full).all()]
    return out[:n]


def _shape(line: str) -> str:
    """Kinds of the words of a line, with the signs before and behind them."""
    out = []
    for w in line.split():
        core = re.sub(r"[^\w/.]", "", w)
        before, behind = w[:1] if not w[0].isalnum() else "", w[-1:] if w[-1] in ",;:-=~¬" and len(w) > 1 else ""
        if re.search(r"\d", core) and not re.search(r"[a-zß-ÿ]{3}", core):
            kind = "9/9" if "/" in core else "9"
        elif core[:1].isupper():
            kind = "U" if len(core) > 1 and core.isupper() else "I." if len(core) == 2 and core[1] == "." else "N"
        else:
            kind = "a" if core.strip(".") else w[1:3]
        out.append(before + kind + behind)
    return " ".join(out)


def features(text: str) -> np.ndarray:
    """Hashed features of the last lines: words, letters, shapes, and how the last line stands to those before."""
    t, omitted = bare(text)
    lines = last_lines(t)
    last, prev, third = ["", "", *lines][-1], ["", "", *lines][-2], ["", "", *lines][-3]
    line = re.sub(r"\d+", "9", last)
    words = line.split()
    folded, before, above = ([fold(w) for w in re.sub(r"\d+", "9", x).split()] for x in (last, prev, third))
    f = ["w" + w for w in words] + ["v" + w for w in folded] + [f"b{a} {b}" for a, b in zip(folded, folded[1:])]
    s = f"^{' '.join(folded)}$"
    for n in (3, 4):
        f += [f"{n}{s[i:i + n]}" for i in range(len(s) - n + 1)]
    e = line.lower()[::-1][:10]
    f += [f"e{k}{e[:k]}" for k in range(1, 8)]
    f += [f"F{folded[0]}", f"L{folded[-1]}", f"L2{' '.join(folded[-2:])}"] if words else ["none"]
    shape, shape_b, shape_a = _shape(last), _shape(prev), _shape(third)
    f += ["s" + shape, "S" + shape[-9:], "p" + shape_b[:16] + "|" + shape, "P" + " ".join(before[:2]) + "|" + shape]
    f += ["x" + w for w in before] + ["y" + w for w in above] + ["X" + shape_b, f"Y{shape_a}|{shape_b}|{shape}", "X2" + " ".join(before[:2]), "Y2" + " ".join(above[:2])]
    # the last two lines as one, whole words across the break, as what is announced may be wrapped anywhere
    joined = prev[:-1] + last if prev[-1:] in HYPHENS and prev else f"{prev} {last}"
    pair = [fold(w) for w in re.sub(r"\d+", "9", joined).split()]
    f += ["V" + w for w in pair] + [f"B{a} {b}" for a, b in zip(pair, pair[1:])] + ["W" + " ".join(_shape(joined).split()[-6:]), "H" + " ".join(pair[:1]) + f"|{len(pair)}"]
    letters = [c for c in last if c.isalpha()]
    f += [f"c{round(4 * sum(c.isupper() for c in letters) / len(letters)) if letters else -1}", f"n{min(8, len(words))}"]
    end, end_a = ("a" if x[-1:].isalpha() else x[-1:] for x in (prev, third))
    f += ["q" + end, "Q" + end_a + end]
    # the unfinished sentence: where it begins and how it goes on
    block = "\n".join(lines)
    stop = max((m.end() for m in _INNER_STOP.finditer(block)), default=-1)
    rest = block[max(stop, 0):].lstrip("\"”“»'’)] ")
    begins = f"{stop >= 0}{rest[:1] == chr(10)}{min(4, rest.strip().count(chr(10)))}"
    opening = (rest.strip().split("\n") or [""])[0]
    f += ["u" + begins, f"U{begins}|{shape}", f"t{begins}|{_shape(opening)[:12]}", f"T{begins}|{' '.join(map(fold, opening.split()[:1]))}", f"R{begins}|{shape_b}|{shape}"]
    width = max([1, *map(len, lines[1:] if len(lines) > 2 else lines)])
    f += [f"l{round(4 * len(last) / width)}", f"m{round(4 * len(prev) / width)}{round(4 * len(third) / width)}", f"o{omitted}", f"z{bool(_STOP.search(t))}{bool(_UNSURE.search(t))}"]
    return np.unique(np.fromiter((xxhash.xxh32_intdigest(x) & (SIZE - 1) for x in f), np.int64, len(f)))


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, rows: list[np.ndarray], step: int = 1024) -> np.ndarray:
        """Scores, taken in steps that bound the memory."""
        out = np.zeros(len(rows))
        for a in range(0, len(rows), step):
            part = rows[a:a + step]
            n = np.array([len(r) for r in part])
            at = np.repeat(np.arange(len(part)), n)
            out[a:a + step] = np.bincount(at, self.weights[np.concatenate(part)], len(part)) / np.sqrt(n) + self.bias
        return out


def fit(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.5, shrink: float = 3e-4, seed: int = 1) -> Model:
    """Logistic regression by AdaGrad, averaged over the later half of the epochs, with weights drawn to zero by `shrink`; the same rows in the same order give the same model."""
    w, b, g2 = np.zeros(SIZE), 0.0, np.full(SIZE, 1e-6)
    n = np.array([len(r) for r in rows])
    rng, order = np.random.default_rng(seed), np.arange(len(rows))
    kept, late = [np.zeros(SIZE), 0.0], epochs - epochs // 2
    for epoch in range(epochs):
        rng.shuffle(order)
        for k in range(0, len(order), batch):
            o = order[k:k + batch]
            at, scale = np.repeat(np.arange(len(o)), n[o]), 1 / np.sqrt(n[o])
            used, back = np.unique(np.concatenate([rows[i] for i in o]), return_inverse=True)
            z = np.bincount(at, w[used][back], len(o)) * scale + b
            err = (1 / (1 + np.exp(-z)) - y[o]) * weight[o]
            g = np.bincount(back, (err * scale)[at], len(used)) / len(o) + shrink * w[used]
            g2[used] += g * g
            w[used] -= rate * g / np.sqrt(g2[used])
            b -= 0.05 * err.mean()
        if epoch >= epochs - late:
            kept = [kept[0] + w / late, kept[1] + b / late]
    return Model(*kept)


def _quantile(x: np.ndarray, n: np.ndarray, q: float) -> float:
    order = np.argsort(x, kind="stable")
    upto = np.cumsum(n[order])
    return float(x[order][np.searchsorted(upto, q * upto[-1])])


def likelihood_curve(as_is: np.ndarray, cut: np.ndarray, count: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Score -> log likelihood ratio of cut against whole at some scores, and the share of cut ones among the texts as they are.

    Two normal distributions fitted by expectation maximisation; the texts cut on purpose count as cut ones with little weight, so
    that the upper distribution stays where cut endings are even if hardly any text as it is was cut. The ratio never falls with the score.
    With `count`, each score in `as_is` stands for so many texts.
    """
    at = np.linspace(LOWEST, -LOWEST, POINTS)
    count = np.ones(len(as_is)) if count is None else np.asarray(count, float)
    n = count.sum()
    if n < 20 or len(cut) < 20:
        return at, np.clip(at, -8, 8), 0.05
    x = np.concatenate((as_is, cut))
    w = np.concatenate((count, np.full(len(cut), 0.05 * n / len(cut))))
    fixed = np.arange(len(x)) >= len(as_is)
    spread = math.sqrt(np.average((as_is - np.average(as_is, weights=count)) ** 2, weights=count))
    mu, sd, share = np.array([_quantile(as_is, count, 0.3), np.median(cut)]), np.array([spread / 2 + 0.1, cut.std() + 0.1]), 0.2
    density = lambda v, k: np.exp(-0.5 * ((v - mu[k]) / sd[k]) ** 2) / sd[k]
    for _ in range(200):
        one, two = (1 - share) * density(x, 0), share * density(x, 1)
        r = np.where(fixed, 1.0, two / (one + two + 1e-300)) * w
        q = w - r
        mu = np.array([(q * x).sum() / q.sum(), (r * x).sum() / r.sum()])
        sd = np.sqrt([(q * (x - mu[0]) ** 2).sum() / q.sum() + 0.05, (r * (x - mu[1]) ** 2).sum() / r.sum() + 0.05])
        share = float(np.clip(r[~fixed].sum() / n, 1e-4, 0.9))
    ratio = np.log(density(at, 1) + 1e-300) - np.log(density(at, 0) + 1e-300)
    middle = int(np.argmin(np.abs(at - mu.mean())))
    ratio[middle:] = np.maximum.accumulate(ratio[middle:])
    ratio[:middle + 1] = np.minimum.accumulate(ratio[:middle + 1][::-1])[::-1]
    return at, np.clip(ratio, -8, 8), share


@dataclass
class Evidence:
    """Models of both halves and the likelihood ratio by score; `cuts` has the scores of the open texts that were cut on purpose."""

    models: tuple[Model, Model]
    curve: tuple[np.ndarray, np.ndarray]
    share: float = 0.05
    cuts: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def scores(self, rows: list[np.ndarray], half: np.ndarray) -> np.ndarray:
        """Scores; texts of one half are judged by the model of the other."""
        out = np.zeros(len(rows))
        for h in (0, 1):
            at = np.flatnonzero(half == h)
            out[at] = self.models[1 - h].score([rows[i] for i in at])
        return out

    def log_ratio(self, scores: np.ndarray) -> np.ndarray:
        return np.interp(scores, *self.curve)


def odds(p):
    """Logarithm of p to 1-p."""
    return np.log(p) - np.log1p(-p)


def share_of_cut(ratio: np.ndarray, count: np.ndarray, start: float, rounds: int = 30) -> float:
    """Share of cut texts among some with these log likelihood ratios, `count` of each, by expectation maximisation."""
    share = min(max(start, 1e-3), 0.5)
    for _ in range(rounds if len(ratio) else 0):
        share = float(np.clip(np.average(1 / (1 + np.exp(-(ratio + odds(share)))), weights=count), 1e-3, 0.9))
    return share


def learn(rows: list[np.ndarray], cut: np.ndarray, half: np.ndarray, done: np.ndarray, censored: np.ndarray | None = None) -> Evidence:
    """Fit from features of endings: `cut` 1 for texts that were cut on purpose, 0 for texts as they are; `half` is 0 or 1, `done` tells
    which texts end with a finished sentence, and `censored` is the chance that a text was cut as its length alone tells.

    Some of the texts as they are were cut before. What tells them apart here is their length alone, never the model's own opinion: an unfinished text counts as a
    whole one as far as its length isn't at a limit. The curve is about unfinished endings only.
    """
    y, weight = cut.astype(float), np.ones(len(cut))
    unsure = np.flatnonzero((y == 0) & ~done)
    if censored is not None:
        weight[unsure] = 1 - np.clip(np.asarray(censored, float)[unsure], 0.0, 1.0)
    models = []
    for h in (0, 1):
        at = np.flatnonzero(half == h)
        models.append(fit([rows[i] for i in at], y[at], weight[at]) if len(at) else Model(np.zeros(SIZE), 0.0))
    found = Evidence((models[0], models[1]), (np.zeros(1), np.zeros(1)))
    z = found.scores(rows, half)
    found.cuts = z[(y == 1) & ~done]
    *curve, found.share = likelihood_curve(z[unsure], found.cuts)
    found.curve = tuple(curve)
    return found
