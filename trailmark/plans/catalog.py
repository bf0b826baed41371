"""Registry of named queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trailmark.sources.testdata import JobSearch, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: The SQL as given, with the views that it adds: for queries whose rows are made of others'.
RAW_SQL: dict[str, tuple[str, dict[str, str]]] = {}


def query(name: str, sql: str | None = None, extra: dict[str, str] | None = None) -> Callable:
    """Registers a function of JobSearch; ``sql`` names views as <view>, ``extra`` adds views."""

    def register(f: Callable[[JobSearch], DataFrame]) -> Callable[[JobSearch], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: f(JobSearch(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = oracle(sql, extra)
            RAW_SQL[name] = (sql, extra or {})
        return f

    return register
