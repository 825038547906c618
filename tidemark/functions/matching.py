"""Schema matching by similarity flooding.

All files of a kind make one graph: nodes are the spelled fields, the containers they are nested in and the kinds of their values; edges say "is inside", "has
values of" and "takes turns with" (two spellings that share a stream but never a file). The target schema is a second graph, in which each field takes turns
with itself. Pairs of nodes form a third graph. A first guess of the similarity of names is passed along its edges,
round after round, until it stays; so a spelling that shares no word with its target gets its similarity from those it takes turns with. Per
file, the consistent, one-to-one choice of the best pairs holds. There are no lists of words.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

MISSING = {"", "null", "na", "nan"}
#: Kinds of values from narrow to wide.
KINDS = ("integer", "decimal", "text", "array")
_INT, _DEC = re.compile(r"[+-]?\d+"), re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")


def text_kind(value: str) -> int | None:
    """Kind of a text by its look, as an index of KINDS; None if it is no value."""
    v = value.strip()
    if v.lower() in MISSING:
        return None
    return 0 if _INT.fullmatch(v) else 1 if _DEC.fullmatch(v) else 2


def words(name: str) -> list[str]:
    """The words of a name: split at case changes, digits stay, signs separate."""
    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", name)
    spaced = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", spaced)
    return [w for w in re.split(r"[^0-9a-z]+", spaced.lower()) if w]


def word_similarity(a: str, b: str) -> float:
    """1 for equal words, less for one that begins the other (an abbreviation), else the share of common letter triples."""
    if a == b:
        return 1.0
    short, long = sorted((a, b), key=len)
    if long.startswith(short):
        return 0.5 + 0.5 * len(short) / len(long) if len(short) > 2 else 0.3
    x, y = ({f" {w} "[i:i + 3] for i in range(len(w))} for w in (a, b))
    return 0.6 * len(x & y) / len(x | y)


def rarity(target: dict[str, int]) -> dict[str, float]:
    """Weight of each word of a target schema: the fewer fields have it, the more it tells."""
    seen: dict[str, int] = defaultdict(int)
    for name in target:
        for w in set(words(name)):
            seen[w] += 1
    return {w: 1.0 / c for w, c in seen.items()}


def name_similarity(a: str, b: str, weight: dict[str, float]) -> float:
    """How much of the words of the target name `b` the spelled name `a` has; words of its own count against it. Containers help, but aren't asked for."""
    if a == b:
        return 1.0
    want = sorted(words(b), key=lambda w: (-weight.get(w, 1.0), w))
    best = 0.0
    for have in (words(a.rsplit(".", 1)[-1]), words(a)):
        if not want or not have:
            continue
        used: set[int] = set()
        got = 0.0
        for w in want:
            fit, at = max(((word_similarity(h, w), -i) for i, h in enumerate(have) if i not in used), default=(0.0, 0))
            if fit >= 0.3:
                got += fit * weight.get(w, 1.0)
                used.add(-at)
        best = max(best, got / (sum(weight.get(w, 1.0) for w in want) + 0.5 * (len(have) - len(used))))
    return 0.95 * best


def holder(name: str) -> str:
    return name.rsplit(".", 1)[0] if "." in name else ""


def flood(
    source: dict[str, dict[int, int]], target: dict[str, int], turns: dict[tuple[str, str], float] | None = None, looks: dict[str, dict[str, int]] | None = None,
    rounds: int = 200, eps: float = 1e-6,
) -> dict[tuple[str, str], float]:
    """Similarity of every field of `source` (name -> files by kind of value) with every field of `target` (name -> kind).

    `turns[a, b]` is the share, up to 1, of the evidence about `b` in which `a` stands where `b` doesn't; what is left to 1 is `b`'s own.
    `looks` has the files of each field by the look of its values; a target field looks like the field that is spelled like it. Runs the fixpoint in which the first guess is added
    in every round, scaled to a maximum of 1, until nothing moves by more than `eps`.
    """
    weight = rarity(target)
    start: dict[tuple[str, str], float] = {(s, t): name_similarity(s, t, weight) for s in source for t in target}
    fields = list(start)
    flows: dict[tuple[str, str], list[tuple[tuple[str, str], float]]] = defaultdict(list)

    def connect(p, q, forth: float, back: float) -> None:
        flows[q].append((p, forth))
        flows[p].append((q, back))

    inside: dict[str, int] = defaultdict(int)
    for s in source:
        inside[holder(s)] += 1
    for h, n in inside.items():
        start["^" + h, "^"] = 0.0 if h else 1.0
    for i, a in enumerate(KINDS):
        for j, b in enumerate(KINDS):
            start["#" + a, "#" + b] = 1.0 / (1 + abs(i - j))
    per_kind = {k: sum(tk == k for tk in target.values()) or 1 for k in range(len(KINDS))}
    for s, kinds in source.items():
        seen = sum(kinds.values())
        for t, tk in target.items():
            n = inside[holder(s)] * len(target)
            connect((s, t), ("^" + holder(s), "^"), 1.0 / n, 0.1 / len(target))
            for k, c in kinds.items():
                connect((s, t), ("#" + KINDS[k], "#" + KINDS[tk]), 1.0 / (len(source) * per_kind[tk]), 0.1 * c / seen)
    shares = shares_of(looks or {})
    for s, mine in shares.items():
        for t in target:
            for f, n in mine.items():
                common = min(n, shares.get(t, {}).get(f, 0.0))
                if common and s in source:
                    start["%" + f, "%"] = 1.0
                    connect((s, t), ("%" + f, "%"), 1.0 / (len(source) * len(target)), 0.5 * common)
    itself = dict.fromkeys(source, 1.0)
    for (a, b), share in (turns or {}).items():
        if a in source and b in source and a != b:
            itself[b] -= share
            for t in target:
                flows[b, t].append(((a, t), share))
    for s, share in itself.items():
        for t in target:
            flows[s, t].append(((s, t), max(share, 0.0)))
    now = dict(start)
    for _ in range(rounds):
        new = {p: start[p] + now[p] + sum(now[q] * c for q, c in flows[p]) for p in start}
        top = max(new.values(), default=1.0) or 1.0
        new = {p: v / top for p, v in new.items()}
        moved = math.sqrt(sum((new[p] - now[p]) ** 2 for p in new))
        now = new
        if moved < eps:
            break
    return {p: now[p] for p in fields}


def shares_of(looks: dict[str, dict[str, int]]) -> dict[str, dict[str, float]]:
    return {s: {f: n / sum(fs.values()) for f, n in fs.items()} for s, fs in looks.items() if fs}


def turn_shares(
    alternate: dict[tuple[str, str], int], together: dict[tuple[str, str], int], gaps: dict[str, int], looks: dict[str, dict[str, int]] | None = None
) -> dict[tuple[str, str], float]:
    """From numbers of streams: in `alternate` both spellings occur, but never in one file, in `together` they do; `gaps` has those in which a spelling is missing at times.

    A pair that is seen together hardly takes turns, and a field that comes and goes by itself takes turns with few: its shares sum to much less than 1.
    """
    raw: dict[tuple[str, str], float] = {}
    shares = shares_of(looks or {})
    for (a, b), n in alternate.items():
        if a != b:
            alike = sum(min(v, shares[b].get(f, 0.0)) for f, v in shares[a].items()) if a in shares and b in shares else 0.5
            raw[a, b] = (0.1 + 0.9 * alike) * n * n / (n + 4.0 * together.get((a, b), 0))
    total: dict[str, float] = defaultdict(float)
    for (_, b), v in raw.items():
        total[b] += v
    return {(a, b): v / max(total[b], float(gaps.get(b, 0))) for (a, b), v in raw.items()}


def by_source(scores: dict[tuple[str, str], float], least: float, relative: float = 0.8) -> dict[str, list[tuple[str, float]]]:
    """By source field, its targets in order of names: those with scores of at least `least`, and of `relative` times the best that the field has with any target, so
    that a field whose own target is taken doesn't fall to one it only resembles."""
    best: dict[str, float] = defaultdict(float)
    for (s, _), v in scores.items():
        best[s] = max(best[s], v)
    out: dict[str, list[tuple[str, float]]] = {s: [] for s in best}
    for (s, t), v in sorted(scores.items()):
        if v >= max(least, relative * best[s]):
            out[s].append((t, v))
    return out


def choose(scores: dict[str, list[tuple[str, float]]]) -> dict[str, str]:
    """Consistent one-to-one correspondences, target field -> source field, of one file's fields: the best pair is chosen first and takes both of its fields out."""
    found: dict[str, str] = {}
    used: set[str] = set()
    for _, s, t in sorted(((v, s, t) for s, ts in scores.items() for t, v in ts), key=lambda x: (-x[0], x[1], x[2])):
        if s not in used and t not in found:
            found[t] = s
            used.add(s)
    return found
