import duckdb
import pytest

import compare
from tidemark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, tables, name):
    con = duckdb.connect()
    for t in ("fills", "run_metrics"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tables}/{t}.parquet')")
    df, cur = queries.QUERIES[name](spark, tables), con.execute(queries.SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    mine = compare.rows_of(df.columns, df.collect())
    assert mine and mine == compare.rows_of(columns, cur.fetchall())


def test_queries(spark, tables):
    rows = {n: f(spark, tables) for n, f in queries.QUERIES.items()}
    assert rows["p8_found"].dtypes == [("doc_id", "bigint")]
    for n, df in rows.items():
        assert df.count() > 0 or n == "p8_limits", n  # a hundred pages show no limit
    assert {r["pack_id"] for r in rows["p6_report"].collect()} == {"short", "medium", "long", "extra"}
    assert len(rows["p7_shares"].collect()) == 52
