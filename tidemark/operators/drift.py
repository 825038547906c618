"""Schemas that drift between files.

Lines are parsed where they lie; per file only the spelled fields with the widest kind of their values are gathered. How often spellings have which kinds, and
which of them take turns in a stream, is counted over all files, and similarity flooding on that graph scores every spelling against the target schema. Each file
then chooses its correspondences, files are windowed in their stream to report changes, and the correspondences go back to the lines to cast and union them.
"""

from __future__ import annotations

import csv
import functools
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import matching
from tidemark.functions.cols import require
from tidemark.session import cut_lineage, ship

# Fields and kinds of the two file formats (fixed values; indices of matching.KINDS).
BARS_TARGET = {"time": 2, "open": 1, "high": 1, "low": 1, "close": 1, "tick_volume": 0, "spread": 0, "real_volume": 0}
METRICS_TARGET = {
    "run_id": 2, "symbol": 2, "timeframe": 2, "n_bars": 0, "start_ts": 2, "end_ts": 2, "starting_capital": 1, "ending_equity": 1,
    "n_trades": 0, "total_pnl": 1, "win_rate": 1, "average_win": 1, "average_loss": 1, "max_drawdown_pct": 1, "risk_halted": 2,
    "risk_halted_at": 2, "daily_drawdown_pct_limit": 1, "monthly_drawdown_pct_limit": 1, "daily_halts": 0, "monthly_halts": 0,
    "git_commit": 2, "git_dirty": 2,
}
DELIMITERS = ",;\t|"
FILE = ["stream_id", "file_name"]
SALT = 16  # parts in which the lines of a file may meet their header
LEAST = 0.25  # similarity, of at most 1, below which a spelling is no match
_ENTRY = "array<struct<name:string,kind:int,value:string>>"


def _delimiter(header: str) -> str:
    bare, quoted = [], False
    for ch in header:
        quoted ^= ch == '"'
        if not quoted:
            bare.append(ch)
    return max(DELIMITERS, key=bare.count)


@functools.lru_cache(4096)
def _header(text: str) -> tuple[str, tuple[str, ...]]:
    head = text.lstrip("﻿")
    d = _delimiter(head)
    names = next(csv.reader([head], delimiter=d, skipinitialspace=True), [])
    return d, tuple(n.strip().strip("\"'").strip() for n in names)


def csv_entries(header: str | None, line: str | None) -> list[tuple[str, int | None, str | None]]:
    """Name, kind and text of each value of a line. Of a name that is twice in the header the first holds; values beyond the header
    are dropped and missing ones are no values. Without a header there is nothing."""
    if not header or line is None or not line.strip():
        return []
    d, names = _header(header)
    try:
        cells = next(csv.reader([line.lstrip("﻿")], delimiter=d, skipinitialspace=True), [])
    except csv.Error:
        return []
    out, seen = [], set()
    for i, n in enumerate(names):
        if n and n not in seen:
            seen.add(n)
            kind = matching.text_kind(cells[i]) if i < len(cells) else None
            out.append((n, kind, cells[i].strip() if kind is not None else None))
    return out


class _Number(str):
    kind = 0


class _Decimal(_Number):
    kind = 1


def json_entries(line: str | None) -> list[tuple[str, int | None, str | None]]:
    """Dotted name, kind and text of each value of a JSON object; kinds as written, so a quoted number is text. Anything but an
    object gives nothing."""
    if line is None:
        return []
    try:
        root = json.loads(line.lstrip("﻿"), parse_int=_Number, parse_float=_Decimal, parse_constant=lambda _: None)
    except (ValueError, RecursionError):
        return []
    if not isinstance(root, dict):
        return []
    out, todo = [], [("", root)]
    while todo:
        name, v = todo.pop()
        if isinstance(v, dict) and v:
            todo.extend((f"{name}.{k}" if name else k, x) for k, x in reversed(v.items()))
        elif isinstance(v, _Number):
            out.append((name, v.kind, str(v)))
        elif isinstance(v, str):
            gone = v.strip().lower() in matching.MISSING
            out.append((name, None if gone else 2, None if gone else v))
        elif isinstance(v, list):
            out.append((name, 3, json.dumps(v)))
        elif isinstance(v, bool):
            out.append((name, 2, str(v).lower()))
        else:
            out.append((name, None, None))
    return out


def parse_lines(raw: DataFrame, once: bool = True) -> DataFrame:
    """One row per line: the file's columns, `line_no` and `entries` (name, kind, value).

    Lines of kind `bars_csv` take their names from the file's line 1, which stays in with the names and no values, so that a field
    without values is known too. With `once`, a line delivered twice counts once, which costs a shuffle of the lines; schemas don't need it, as
    repeated lines don't change them. Lines of other kinds, null lines and lines that can't be read have no entries.
    """
    require(raw, *FILE, "kind", "file_date", "line_no", "line_text")
    ship(raw.sparkSession)
    lines = raw.select(*FILE, "kind", "file_date", "line_no", "line_text")
    if once:
        lines = lines.groupBy(*FILE, "kind", "line_no").agg(F.min("file_date").alias("file_date"), F.max("line_text").alias("line_text"))
    is_csv = F.coalesce(F.col("kind") == "bars_csv", F.lit(False))
    heads = (
        raw.where(is_csv & (F.col("line_no") == 1)).groupBy(*FILE).agg(F.max("line_text").alias("header"))
        .select(F.col("stream_id").alias("_hs"), F.col("file_name").alias("_hf"), "header", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("_part"))
    )
    # only lines that need a header meet the headers; a file's lines are spread, so a giant file is no hot key
    part = F.pmod(F.col("line_no"), F.lit(SALT)) == F.col("_part")
    with_head = lines.where(is_csv).join(heads, (F.col("stream_id") == F.col("_hs")) & (F.col("file_name") == F.col("_hf")) & part, "left").drop("_hs", "_hf", "_part")
    joined = with_head.unionByName(lines.where(~is_csv).withColumn("header", F.lit(None).cast("string")))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            entries = []
            for kind, no, head, text in zip(b["kind"], b["line_no"], b["header"], b["line_text"]):
                head, text = (x if isinstance(x, str) else None for x in (head, text))
                if kind == "bars_csv":
                    e = [(n, None, None) for n, _, _ in csv_entries(head, head)] if no == 1 else csv_entries(head, text)
                else:
                    e = json_entries(text) if kind == "metrics_json" else []
                entries.append([{"name": n, "kind": k, "value": v} for n, k, v in e])
            yield b[[*FILE, "kind", "file_date", "line_no"]].assign(entries=entries)

    kinds = dict(joined.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*FILE, "kind", "file_date", "line_no"]) + f", entries {_ENTRY}"
    return joined.mapInPandas(read, schema)


def look(value: Column) -> Column:
    """What a value looks like: the kind of its signs and the magnitude of its length."""
    signs = F.when(value.rlike(r"^[\[{]"), "list").when(value.rlike("^[0-9]+$"), "digits").when(value.rlike("^[A-Za-z]+$"), "letters").when(
        value.rlike("^[0-9A-Za-z]+$"), "both").when(value.rlike("^[0-9.eE+-]+$"), "number").otherwise("signs")
    size = F.when(value.rlike(r"^[\[{]"), "").otherwise(F.floor(F.log2(F.greatest(F.length(value), F.lit(1)))).cast("string"))
    return F.when(value.isNotNull(), F.concat(signs, size))


def file_schemas(parsed: DataFrame) -> DataFrame:
    """One row per file: `fields`, its spelled fields with the index of the widest kind and a look of their values (null: no value), in name order."""
    fields = parsed.select(*FILE, "kind", "file_date", F.explode_outer("entries").alias("e")).groupBy(*FILE, "kind", F.col("e.name").alias("name"))
    widest = fields.agg(F.min("file_date").alias("file_date"), F.max("e.kind").alias("widest"), F.max(look(F.col("e.value"))).alias("look"))
    named = F.when(F.col("name").isNotNull(), F.struct("name", "widest", "look"))
    return widest.groupBy(*FILE, "kind").agg(F.min("file_date").alias("file_date"), F.sort_array(F.collect_list(named)).alias("fields"))


def _pairs(names: Column) -> Column:
    """All pairs of an array of field names, the smaller first."""
    both = F.flatten(F.transform(names, lambda a: F.transform(F.filter(names, lambda b: a < b), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return F.explode(both)


def spelling_scores(schemas: DataFrame, targets: dict[str, dict[str, int]], least: float = LEAST) -> DataFrame:
    """Similarity of every spelling of a kind of files with every target field, by flooding the graph of all its files: `kind`, `name`, `scores`.

    Counted are the files of each spelling by kind and look of their values, the streams in which a spelling is missing at times, and, for pairs of such
    spellings, the streams in which they share a file or never do. A row of the counts stands for spellings, whose number follows the width of the schemas and not the number of
    files or lines; those of one kind are flooded in one task.
    """
    ship(schemas.sparkSession)
    stream = ["kind", "stream_id"]
    names = schemas.select(*stream, "file_name", F.explode("fields").alias("f")).select(*stream, "f.*")
    looks = names.groupBy("kind", F.col("name").alias("a"), F.col("look").alias("b"), F.col("widest").alias("x")).agg(F.count(F.lit(1)).alias("y"))
    files = schemas.groupBy(*[F.col(c).alias(f"_{c}") for c in stream]).agg(F.count(F.lit(1)).alias("_files"))
    same_stream = F.col("kind").eqNullSafe(F.col("_kind")) & F.col("stream_id").eqNullSafe(F.col("_stream_id"))
    at_times = names.groupBy(*stream, "name").agg(F.count(F.lit(1)).alias("_n")).join(files, same_stream).where(F.col("_n") < F.col("_files")).select(*stream, "name")
    gaps = at_times.groupBy("kind", F.col("name").alias("a")).agg(F.count(F.lit(1)).alias("y"))
    sets = at_times.groupBy(*stream).agg(F.collect_list("name").alias("_names"))
    held = schemas.join(sets.select(F.col("kind").alias("_kind"), F.col("stream_id").alias("_stream_id"), "_names"), same_stream)
    present = F.array_intersect(F.transform("fields", lambda f: f["name"]), F.col("_names"))
    shared = held.select(*stream, _pairs(present).alias("p"), F.lit(1).alias("_shared")).unionByName(sets.select(*stream, _pairs(F.col("_names")).alias("p"), F.lit(0).alias("_shared")))
    pairs = shared.groupBy(*stream, F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.max("_shared").alias("_shared")).groupBy("kind", "a", "b").agg(
        F.count_if(F.col("_shared") == 0).alias("x"), F.sum("_shared").alias("y"))
    tagged = lambda df, what, **more: df.select("kind", F.lit(what).alias("what"), "a", *[more.get(c, F.col(c)).alias(c) for c in "bxy"])
    none = F.lit(None)
    facts = tagged(looks, "look", x=F.col("x").cast("bigint")).unionByName(tagged(pairs, "pair")).unionByName(tagged(gaps, "gap", b=none.cast("string"), x=none.cast("bigint")))

    def score(facts: pd.DataFrame) -> pd.DataFrame:
        kind = facts["kind"].iloc[0]
        kinds, seen, gap, apart, shared = {}, {}, {}, {}, {}
        for what, a, b, x, y in facts[["what", "a", "b", "x", "y"]].itertuples(index=False):
            if what == "gap":
                gap[a] = int(y)
            elif what == "pair":
                for p in ((a, b), (b, a)):
                    apart[p], shared[p] = int(x), int(y)
            else:
                of, by = kinds.setdefault(a, {}), seen.setdefault(a, {})
                if pd.notna(x):
                    of[int(x)] = of.get(int(x), 0) + int(y)
                if isinstance(b, str):
                    by[b] = by.get(b, 0) + int(y)
        turns = matching.turn_shares({p: n for p, n in apart.items() if n}, shared, gap, seen)
        found = matching.by_source(matching.flood(dict(sorted(kinds.items())), targets.get(kind, {}), dict(sorted(turns.items())), seen), least)
        return pd.DataFrame([(kind, s, [{"field": t, "score": v} for t, v in ts]) for s, ts in found.items() if ts], columns=["kind", "name", "scores"])

    return facts.where(F.col("kind").isin(list(targets))).groupBy("kind").applyInPandas(score, "kind string, name string, scores array<struct<field:string,score:double>>")


@functools.lru_cache(65_536)
def _match(fields: tuple) -> list[dict]:
    kinds = {n: k for n, k, _ in fields}
    chosen = matching.choose({n: list(scores) for n, _, scores in fields})
    return [{"field": t, "name": s, "kind": kinds[s]} for t, s in sorted(chosen.items())]


def match_files(schemas: DataFrame, targets: dict[str, dict[str, int]]) -> DataFrame:
    """Adds `matches`: target field, how the file spells it, and its kind. Schemas that are alike are matched once per task.

    The schemas, a row per file, are read several times, so they are written to the checkpoint folder once.
    """
    schemas = cut_lineage(schemas)
    scores = spelling_scores(schemas, targets).select(F.col("kind").alias("_k"), F.col("name").alias("_n"), "scores")
    fields = schemas.select(*FILE, "kind", "file_date", F.explode_outer("fields").alias("f")).select(*FILE, "kind", "file_date", "f.name", "f.widest")
    scored = fields.join(scores, (F.col("kind") == F.col("_k")) & (F.col("name") == F.col("_n")), "left")
    told = F.when(F.col("scores").isNotNull(), F.struct("name", "widest", "scores"))
    per_file = scored.groupBy(*FILE, "kind", "file_date").agg(F.sort_array(F.collect_list(told)).alias("fields"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            key = [tuple((f["name"], None if f["widest"] is None else int(f["widest"]), tuple((x["field"], x["score"]) for x in f["scores"])) for f in fs) for fs in b["fields"]]
            yield b[[*FILE, "kind", "file_date"]].assign(matches=[_match(f) for f in key])

    kinds = dict(schemas.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*FILE, "kind", "file_date"]) + ", matches array<struct<field:string,name:string,kind:int>>"
    return per_file.mapInPandas(run, schema)


def _one_match(field: str) -> Column:
    return F.get(F.filter("matches", lambda m: m["field"] == field), F.lit(0))


def schema_changes(matched: DataFrame, fields: dict[str, list[str]]) -> DataFrame:
    """Changes of the given fields (by kind of file) from file to file: the file, `field`, `change_kind`, `old` and `new`.

    Files of a stream follow each other by date, then name. `added` and `removed` are against the file before, `renamed` means in both but
    spelt otherwise, `type_changed` that the kind differs from that in the last earlier file that had a value. A stream's
    first file has no changes.
    """
    w = Window.partitionBy("stream_id", "kind").orderBy("file_date", "file_name")
    names = sorted({f for fs in fields.values() for f in fs})
    picked = matched.select(*FILE, "kind", "file_date", F.row_number().over(w).alias("_n"), *[
        _one_match(f).alias(f"_{i}") for i, f in enumerate(names)
    ])
    changes = []
    for i, f in enumerate(names):
        at: Column = F.col(f"_{i}")
        name, kind = at["name"], at["kind"]
        before = F.lag(name).over(w)
        told = F.last(kind, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        mine = F.col("kind").isin([k for k, fs in fields.items() if f in fs]) & (F.col("_n") > 1)
        kind_name = lambda c: F.get(F.array(*[F.lit(k) for k in matching.KINDS]), c)
        case = lambda cond, what, old, new, f=f, mine=mine: F.when(
            mine & cond, F.struct(F.lit(f).alias("field"), F.lit(what).alias("change_kind"), old.alias("old"), new.alias("new"))
        )
        changes += [
            case(before.isNull() & name.isNotNull(), "added", before, name),
            case(before.isNotNull() & name.isNull(), "removed", before, name),
            case(before != name, "renamed", before, name),
            case(told != kind, "type_changed", kind_name(told), kind_name(kind)),
        ]
    listed = picked.select(*FILE, F.array(*changes).alias("_all"))
    return listed.select(*FILE, F.explode(F.filter("_all", lambda x: x.isNotNull())).alias("_c")).select(*FILE, "_c.*")


NUMBER = r"^\s*[~#]?\s*([+-]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d*)?|[+-]?\.\d+)((?:[eE][+-]?\d+)?)(k?)\??(?:\s+[A-Za-z]+)?\s*$"


def as_number(text: Column, kind: str) -> Column:
    """A value's text as a number, or null unless all of it is one number.

    Around the number there may be a mark for "about" or "number" before, a doubt mark, an SI `k` or a unit's name behind; commas may only part groups of three
    digits. Dates, several numbers and decimal commas are null.
    """
    digits = F.regexp_replace(F.regexp_extract(text, NUMBER, 1), ",", "")
    value = F.concat(digits, F.regexp_extract(text, NUMBER, 2)).try_cast("double")
    value = F.when(F.regexp_extract(text, NUMBER, 3) == "k", value * 1000).otherwise(value)
    return F.round(value).try_cast("bigint") if kind == "bigint" else value


def unify(parsed: DataFrame, matched: DataFrame, kind: str, columns: dict[str, str]) -> DataFrame:
    """All lines of one kind of file as one table: the file, `line_no`, the given columns, cast to the given types, and `other`.

    Columns that a file doesn't have are null, and so are values that can't be cast. `other` maps the name, as spelled in the file, to the text of
    every field that isn't in a column: fields without a match, or with one that isn't asked for, and values that can't be cast. A field
    without a value has a null there. Header lines and lines without entries aren't in it.
    """
    if "other" in columns:
        raise ValueError("'other' holds the remaining fields and can't be a column")
    fields = matched.where(F.col("kind") == kind).select(
        F.col("stream_id").alias("_ms"), F.col("file_name").alias("_mf"), F.map_from_entries(F.transform("matches", lambda m: F.struct(m["field"], m["name"]))).alias("_map")
    )
    data = parsed.where((F.col("kind") == kind) & (F.size("entries") > 0))
    if kind == "bars_csv":
        data = data.where(F.col("line_no") > 1)
    joined = data.join(fields, (F.col("stream_id") == F.col("_ms")) & (F.col("file_name") == F.col("_mf")))
    values = joined.withColumn("_v", F.map_from_entries(F.transform("entries", lambda e: F.struct(e["name"], e["value"]))))
    out, held = [], []
    for c, typ in columns.items():
        name = F.element_at("_map", F.lit(c))
        text = F.element_at("_v", name)
        value = as_number(text, typ) if typ in ("bigint", "double") else text.try_cast(typ)
        out.append(value.alias(c))
        held.append(F.when(value.isNotNull() | text.isNull(), name))
    rest = values.select(*FILE, "line_no", *out, "_v", F.array_compact(F.array(*held)).alias("_held"))
    return rest.select(*FILE, "line_no", *columns, F.map_filter("_v", lambda k, _: ~F.array_contains("_held", k)).alias("other"))
