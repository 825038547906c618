import math

import duckdb
import pytest

import compare
from tidemark.plans import catalog

ROWS_ONLY = sorted(set(catalog.QUERIES) - set(catalog.SQL))


@pytest.fixture(scope="module")
def duck(tables):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in compare.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tables}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_sql(spark, duck, tables, name):
    df = catalog.QUERIES[name](spark, tables)
    cur = duck.execute(catalog.SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    mine, theirs = compare.rows_of(df.columns, df.collect()), compare.rows_of(columns, cur.fetchall())
    assert mine == theirs and mine


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_runs_and_has_no_nan(spark, tables, name):
    rows = catalog.QUERIES[name](spark, tables).collect()
    assert rows and not any(isinstance(v, float) and math.isnan(v) for r in rows for v in r)


def test_entry_and_columns(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    q, base = entry.queries(), "/root/testdata/sf0.001"
    want = {
        "p1_found": [("snapshot_id", "string"), ("bar_epoch", "bigint"), ("change_kind", "string")],
        "p2_found": [(c, "string") for c in ("stream_id", "file_name", "field", "change_kind")],
        "p3_found": [("broker", "string"), ("symbol", "string"), ("slot_epoch", "bigint")], "p5_found": [("broker", "string"), ("symbol", "string"), ("time_ms", "bigint")],
    }
    for name, dtypes in want.items():
        df = q[name](spark, base)
        assert df.dtypes == dtypes and df.count() == df.distinct().count()
