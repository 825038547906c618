"""Snapshots of bars: directories of CSV or Parquet files with a META.json beside them."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.validate import ARRIVAL, first_wins
from tidemark.schema import BAR_COLUMNS, RAW_BARS, coalesce_volume


def data_files(directory: str, suffix: str = ".csv") -> list[Path]:
    """The directory's files in order of their names; files in folders below it don't count."""
    return sorted(p for p in Path(directory).resolve().iterdir() if p.is_file() and p.suffix == suffix)


def read_snapshot(spark: SparkSession, directory: str, arrival: bool = True) -> DataFrame:
    """All bars of a snapshot with `volume` and, if `arrival`, their order of arrival.

    Files follow each other by name and rows as they stand in the file: the order is (file, start of the split, number in the task),
    taken on the scan before anything is shuffled. Columns are typed as bars; malformed values fail. Files with different columns are read by
    their headers and united by name. A directory without CSV files is an error.
    """
    files = data_files(directory)
    if not files:
        raise FileNotFoundError(f"No CSV files in {directory}")
    by_header: dict[tuple, list[str]] = {}
    for f in files:
        with f.open(encoding="utf-8-sig") as h:
            by_header.setdefault(tuple(c.strip() for c in h.readline().strip().split(",")), []).append(str(f))
    kinds = {f.name: f.dataType.simpleString() for f in RAW_BARS.fields} | {"volume": "double"}
    out = None
    for header, paths in by_header.items():
        schema = ", ".join(f"`{c}` {kinds.get(c, 'string')}" for c in header)
        part = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(paths)
        meta = F.col("_metadata")
        order = F.struct(meta["file_name"].alias("file"), meta["file_block_start"].alias("at"), F.monotonically_increasing_id().alias("n"))
        part = part.select("*", order.alias(ARRIVAL)) if arrival else part
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return coalesce_volume(out)


def data_reference(directory: str, row_count: int, label: str | None = None) -> dict:
    """Names and sizes of a snapshot's files with a hash over them (not over their content)."""
    files = [{"name": p.name, "size_bytes": p.stat().st_size} for p in data_files(directory)]
    text = "|".join(f"{f['name']}:{f['size_bytes']}" for f in files)
    return {"snapshot_path": label or directory, "row_count": row_count, "files": files, "files_hash_sha256": hashlib.sha256(text.encode()).hexdigest()}


def write_atomically(path: Path, text: str) -> None:
    """Write beside the target and rename, so a failure leaves the old file."""
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent)
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(name, path)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


def _by_year(bars: DataFrame) -> DataFrame:
    year = F.year(F.to_utc_timestamp(F.col("time"), F.current_timezone()))
    return bars.withColumn("_year", year)


def year_counts(bars: DataFrame, keys: list[str]) -> DataFrame:
    """Bars by key and UTC `year`, each time once: `n_bars`."""
    return _by_year(bars.where(F.col("time").isNotNull())).groupBy(*keys, F.col("_year").alias("year")).agg(F.countDistinct("time").alias("n_bars"))


def ranges(bars: DataFrame, keys: list[str]) -> DataFrame:
    """What the metadata of a snapshot tell of its bars as fetched: `total_rows`, and `range_start` and `range_end` in epoch seconds; one row without keys."""
    t = F.unix_seconds("time")
    return bars.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_rows"), F.min(t).alias("range_start"), F.max(t).alias("range_end"))


def write_yearly(bars: DataFrame, directory: str, symbol: str, timeframe: str = "M5") -> list[str]:
    """Write bars to one CSV a UTC year, `<symbol>_<timeframe>_<year>.csv`, sorted and each time once; existing rows win over new ones.

    Spark writes each year by a task of its own into a folder beside the target, from which the files are renamed. Years without new bars stay untouched.
    Returns the names of the files written. No bars write nothing.
    """
    spark, base = bars.sparkSession, Path(directory).resolve()
    new = bars.select(*[c for c in BAR_COLUMNS if c in bars.columns]).where(F.col("time").isNotNull())
    years = sorted(r["year"] for r in year_counts(new, []).collect())
    old = [str(p) for y in years if (p := base / f"{symbol}_{timeframe}_{y}.csv").exists()]
    if not years:
        return []
    kinds = {f.name: f.dataType.simpleString() for f in RAW_BARS.fields}
    had = spark.read.schema(", ".join(f"`{c}` {kinds[c]}" for c in new.columns)).option("header", True).csv(old) if old else new.limit(0)
    merged = _by_year(first_wins(had, new, ["time"])).repartition(len(years), "_year").sortWithinPartitions("_year", "time")
    text = F.date_format(F.to_utc_timestamp(F.col("time"), F.current_timezone()), "yyyy-MM-dd HH:mm:ss")
    base.mkdir(parents=True, exist_ok=True)
    with tempfile.TemporaryDirectory(dir=base, prefix=".writing-") as tmp:
        merged.withColumn("time", F.concat(text, F.lit("+00:00"))).write.partitionBy("_year").option("header", True).csv(f"{tmp}/years")
        written = []
        for folder in sorted(Path(tmp, "years").glob("_year=*")):
            parts = sorted(folder.glob("part-*"))
            name = f"{symbol}_{timeframe}_{folder.name.split('=')[1]}.csv"
            if len(parts) != 1:
                raise RuntimeError(f"{len(parts)} files for {name}")
            os.replace(parts[0], base / name)
            written.append(name)
    return written


def write_partitioned(bars: DataFrame, path: str, keys: tuple[str, ...] = ("symbol",)) -> None:
    """Write bars to Parquet by key and UTC year, sorted by time; only the years that come are replaced. For tables of many symbols."""
    rows = _by_year(bars).withColumnRenamed("_year", "year")
    rows.repartition(*keys, "year").sortWithinPartitions(*keys, "year", "time").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys, "year").parquet(path)


def snapshot_id(now: datetime | None = None) -> str:
    return (now or datetime.now(UTC)).strftime("%Y%m%d_%H%M%S")


def write_meta(directory: str, id: str, symbol: str, broker: str, range_start: str, range_end: str, total_rows: int, timeframe: str = "M5") -> dict:
    """META.json; `total_rows` counts the rows as fetched, before equal times were made one."""
    meta = {
        "snapshot_id": id, "symbol": symbol, "timeframe": timeframe, "broker": broker, "range_start": range_start, "range_end": range_end,
        "total_rows": total_rows, "downloaded_utc": datetime.now(UTC).isoformat(),
    }
    write_atomically(Path(directory) / "META.json", json.dumps(meta, indent=2))
    return meta


# The first line of the version log and the form of its entries (fixed values).
LOG_HEADER = "# Data Version Log"
LOG_ENTRY = "{day} [{id}]: Exported {symbol} {timeframe} from MT5 terminal <{broker}>, range {start}..{end}."


def append_version(path: str, id: str, symbol: str, broker: str, range_start: str, range_end: str, timeframe: str = "M5") -> None:
    """Add an entry to the version log, which gets its header if it has none; a byte order mark is taken off."""
    target = Path(path)
    entry = LOG_ENTRY.format(day=f"{datetime.now(UTC):%Y-%m-%d}", id=id, symbol=symbol, timeframe=timeframe, broker=broker, start=range_start, end=range_end)
    before = target.read_text(encoding="utf-8-sig").rstrip("\r\n") if target.exists() else ""
    parts = [] if before.startswith("#") else [LOG_HEADER]
    write_atomically(target, "".join(x + "\n" for x in [*parts, *([before] if before else []), entry]))


class YearlyCsv:
    """Writer of one CSV a year, as in `write_yearly`."""

    def write(self, bars: DataFrame, directory: str, symbol: str) -> list[str]:
        return write_yearly(bars, directory, symbol)


class PartitionedParquet:
    """Writer of Parquet by symbol and year into the folder `bars`, as in `write_partitioned`."""

    def write(self, bars: DataFrame, directory: str, symbol: str) -> list[str]:
        write_partitioned(bars.withColumn("symbol", F.lit(symbol)), f"{directory}/bars")
        return [f"bars/symbol={symbol}"]


def write_csv(df: DataFrame, path: Path, order: str) -> None:
    """Rows of one series as one CSV with a header, sorted and written by one task beside the target and renamed."""
    with tempfile.TemporaryDirectory(dir=path.parent.resolve(), prefix=".writing-") as tmp:
        df.repartition(1).sortWithinPartitions(order).write.option("header", True).option("emptyValue", "").csv(f"{tmp}/rows")
        parts = sorted(Path(tmp, "rows").glob("part-*"))
        if parts:
            os.replace(parts[0], path)
        else:
            path.write_text(",".join(df.columns) + "\n")
