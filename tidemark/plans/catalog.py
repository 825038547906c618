"""All queries of the core."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import bar_queries, problem_queries

QUERIES = {**bar_queries.QUERIES, **problem_queries.QUERIES}
SQL = {**bar_queries.SQL, **problem_queries.SQL}


def flagship(spark: SparkSession, base: str) -> DataFrame:
    return QUERIES["metrics"](spark, base)
