import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators.validate import ARRIVAL, validate_bars, validation_counts
from tidemark.sources import feed, snapshot

UTC = dt.UTC


def bar(t, close=1.0):
    return {"time": int(t.timestamp()), "open": 1.0, "high": 2.0, "low": 0.5, "close": close, "tick_volume": 5, "spread": 1, "real_volume": 0}


class Client(feed.MemoryClient):
    rows = [bar(dt.datetime(2019, 12, 31, 23, 55, tzinfo=UTC) + k * dt.timedelta(days=7, minutes=5), float(k)) for k in range(60)] + [bar(dt.datetime(2020, 5, 1, tzinfo=UTC))] * 2


class Empty(feed.MemoryClient):
    pass


def frame(spark, rows):
    return spark.createDataFrame([tuple(dt.datetime.fromtimestamp(r["time"], UTC) if c == "time" else r[c] for c in snapshot.BAR_COLUMNS) for r in rows], snapshot.RAW_BARS)


CONFIG = {"symbol": "EURX", "start": "2019-10-01", "end": "2021-03-01", "probe_pause_s": 0.0, "open_pause_s": 0.0}


def test_snapshot_from_a_client(spark, tmp_path):
    path = feed.make_snapshot(spark, str(tmp_path), client=f"{__name__}:Client", **CONFIG)
    assert [p.name for p in snapshot.data_files(path)] == ["EURX_M5_2019.csv", "EURX_M5_2020.csv", "EURX_M5_2021.csv"]
    meta = json.loads((tmp_path / path / "META.json").read_text())
    assert meta["total_rows"] == 62 and (meta["range_start"], meta["broker"], meta["timeframe"]) == ("2019-12-31", "memory", "M5")
    log = (tmp_path / "DATA_VERSION.md").read_text().splitlines()
    assert log[0] == "# Data Version Log" and log[1].endswith("]: Exported EURX M5 from MT5 terminal <memory>, range 2019-12-31..2021-02-17.") and len(log) == 2
    read = snapshot.read_snapshot(spark, path)
    assert read.count() == 61 and "volume" in read.columns
    validate_bars(read)
    assert [r["close"] for r in read.orderBy("time").select("close").limit(3).collect()] == [0.0, 1.0, 2.0]
    assert (tmp_path / path / "EURX_M5_2019.csv").read_text().splitlines()[1].startswith("2019-12-31 23:55:00+00:00,")


def test_no_bars_leave_nothing(spark, tmp_path):
    assert feed.make_snapshot(spark, str(tmp_path), client=f"{__name__}:Empty", **CONFIG) is None
    assert list(tmp_path.iterdir()) == []


def test_existing_rows_win(spark, tmp_path):
    t = dt.datetime(2020, 1, 1, tzinfo=UTC)
    assert snapshot.write_yearly(frame(spark, [bar(t, 1.0), bar(t, 1.0)]), str(tmp_path), "X") == ["X_M5_2020.csv"]
    later = t + dt.timedelta(minutes=5)
    snapshot.write_yearly(frame(spark, [bar(later, 3.0), bar(t, 2.0)]), str(tmp_path), "X")
    assert [(r["time"].minute, r["close"]) for r in snapshot.read_snapshot(spark, str(tmp_path)).orderBy("time").collect()] == [(0, 1.0), (5, 3.0)]
    assert snapshot.write_yearly(frame(spark, []), str(tmp_path), "X") == []
    assert sorted(p.name for p in tmp_path.iterdir()) == ["X_M5_2020.csv"]


def test_partitioned_years_are_replaced_alone(spark, tmp_path):
    t = dt.datetime(2020, 12, 31, 23, 55, tzinfo=UTC)
    rows = frame(spark, [bar(t, 1.0), bar(t + dt.timedelta(minutes=5), 2.0)]).withColumn("symbol", F.lit("X"))
    snapshot.write_partitioned(rows, str(tmp_path / "t"))
    snapshot.write_partitioned(rows.where("close = 2").withColumn("close", F.lit(9.0)), str(tmp_path / "t"))
    assert {(r["year"], r["close"]) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {(2020, 1.0), (2021, 9.0)}


def test_arrival_order_over_files(spark, tmp_path):
    head = ",".join(snapshot.BAR_COLUMNS)
    (tmp_path / "b.csv").write_text(f"{head}\n2020-01-01 00:00:00+00:00,1,1,1,1,1,1,1\n")
    (tmp_path / "a.csv").write_text(f"{head}\n2020-01-02 00:00:00+00:00,1,1,1,1,1,1,1\n2020-01-03 00:00:00+00:00,1,1,1,1,1,1,1\n")
    (tmp_path / "c.csv").write_text(f"{head},note\n2020-01-04 00:00:00+00:00,1,1,1,1,1,1,1,x\n")
    (tmp_path / "sub").mkdir()
    df = snapshot.read_snapshot(spark, str(tmp_path))
    assert [r["time"].day for r in df.orderBy(ARRIVAL).collect()] == [2, 3, 1, 4]
    with pytest.raises(ValueError, match="monotonic"):
        validate_bars(df)


def test_malformed_and_missing(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        snapshot.read_snapshot(spark, str(tmp_path))
    (tmp_path / "a.csv").write_text("time,close\n2020-01-01,oops\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        snapshot.read_snapshot(spark, str(tmp_path)).collect()


def test_reference_hash(tmp_path):
    (tmp_path / "a.csv").write_bytes(b"123")
    (tmp_path / "b.csv").write_bytes(b"")
    ref = snapshot.data_reference(str(tmp_path), 7)
    import hashlib

    assert ref["files_hash_sha256"] == hashlib.sha256(b"a.csv:3|b.csv:0").hexdigest() and ref["row_count"] == 7 and len(ref["files"]) == 2


def test_version_log_mends_header(tmp_path):
    p = tmp_path / "v.md"
    p.write_bytes("﻿old line\r\n".encode())
    snapshot.append_version(str(p), "1", "X", "b", "2020", "2021")
    assert p.read_text().splitlines()[:2] == [snapshot.LOG_HEADER, "old line"] and "﻿" not in p.read_text()


def test_atomic_write_keeps_the_old_file(tmp_path, monkeypatch):
    p = tmp_path / "x"
    p.write_text("old")
    monkeypatch.setattr(snapshot.os, "replace", lambda *a: (_ for _ in ()).throw(OSError("no")))
    with pytest.raises(OSError):
        snapshot.write_atomically(p, "new")
    assert p.read_text() == "old" and list(tmp_path.iterdir()) == [p]


def opened(client, **given):
    return feed.terminal(feed.settings(client=f"{__name__}:{client}", **{**CONFIG, **given}))


class Shy(Client):
    fails = []


class Broken(Client):
    def fetch_from(self, symbol, start, n):
        return None

    fetch = fetch_from


def test_opening_retries_only_without_authorisation():
    Shy.fails = [-6, -6]
    with opened("Shy", login="7", server="s") as c:
        assert c.options == {"login": "7", "server": "s"} and not Shy.fails
    for fails, n in (([-1], 1), ([-6] * 20, 15), ([-6, -1, -6], 2)):
        Shy.fails = fails
        with pytest.raises(feed.FeedError, match=f"after {n} attempt"), opened("Shy"):
            pass
    Shy.fails = []
    with pytest.raises(feed.FeedError, match="select"), opened("Shy", symbol=" "):
        pass


def test_failing_client_is_no_missing_bar(spark, tmp_path):
    with pytest.raises(feed.FeedError, match="first bar"):
        feed.make_snapshot(spark, str(tmp_path), client=f"{__name__}:Broken", **CONFIG)
    with pytest.raises(Exception, match="range failed"):
        feed.read_feed(spark, feed.settings(client=f"{__name__}:Broken", **CONFIG), dt.datetime(2020, 1, 1, tzinfo=UTC)).collect()
    assert list(tmp_path.iterdir()) == []


def test_tasks_retry_and_select(spark):
    """Executors open the client like the driver does: a task's client that isn't authorised at first is tried again."""
    s = feed.settings(client=f"{__name__}:Late", **CONFIG)
    assert feed.read_feed(spark, s, dt.datetime(2020, 4, 1, tzinfo=UTC)).where("time >= '2020-05-01' AND time < '2020-05-02'").count() == 2


class Late(Client):
    def __init__(self, **options):
        super().__init__(**options)
        self.fails, self.chosen = [-6, -6, -6], None

    def select(self, symbol):
        self.chosen = symbol
        return True

    def fetch(self, symbol, start, end):
        return super().fetch(symbol, start, end) if self.chosen == symbol else None


def test_settings():
    s = feed.settings(symbol="X", chunk_days="30", path=None)
    assert s["chunk_days"] == 30 and s["probes"] == 365 and s["path"] is None and feed.last_moment(s) < dt.datetime.now(UTC)
    with pytest.raises(ValueError, match="nix"):
        feed.settings(nix=1)


def test_other_writers(spark, tmp_path):
    assert isinstance(snapshot.YearlyCsv(), feed.BarWriter) and isinstance(snapshot.PartitionedParquet(), feed.BarWriter)
    path = feed.make_snapshot(spark, str(tmp_path), snapshot.PartitionedParquet(), client=f"{__name__}:Client", **CONFIG)
    assert {(r["symbol"], r["year"]) for r in spark.read.parquet(f"{path}/bars").select("symbol", "year").distinct().collect()} == {("EURX", y) for y in (2019, 2020, 2021)}


def test_probe_and_chunks():
    s = feed.settings(**CONFIG)
    assert feed.first_bar(Client(), s) == dt.datetime(2019, 12, 31, 23, 55, tzinfo=UTC)
    assert feed.first_bar(Empty(), s | {"probes": 3}) is None
    a, b = dt.datetime(2020, 1, 1, tzinfo=UTC), dt.datetime(2021, 1, 1, tzinfo=UTC)
    parts = feed.chunks(a, b, 180)
    assert parts[0] == (a, a + dt.timedelta(days=180)) and parts[-1][1] == b and all(y[0] - x[1] == dt.timedelta(seconds=1) for x, y in zip(parts, parts[1:]))
    assert feed.chunks(b, a, 180) == [] and isinstance(Client(), feed.Client)


def test_order_within_and_between_splits(spark):
    at = lambda f, k, n: (f, k, n)
    rows = [("s", dt.datetime(2020, 1, d), at(f, k, n)) for d, f, k, n in ((1, "a", 0, 5), (3, "a", 0, 6), (2, "a", 0, 7), (4, "a", 9, 1), (3, "b", 0, 0), (5, "b", 0, 1))]
    df = spark.createDataFrame(rows, f"symbol string, time timestamp, {ARRIVAL} struct<file:string,at:bigint,n:bigint>")
    assert validation_counts(df).first()["out_of_order"] == 2 and validation_counts(df, ["symbol"]).first()["out_of_order"] == 2
    assert validation_counts(df).first()["n_rows"] == 6 and validation_counts(df.limit(0)).first()["out_of_order"] == 0
