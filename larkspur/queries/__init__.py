"""Named queries over a folder of Parquet tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larkspur.engine import Engine
from larkspur.sources.testdata import catalog

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
SQL: dict[str, str] = {}


def rest(name: str, table: str, query: str, sql: str, then: Callable[[DataFrame], DataFrame] | None = None, **engine) -> None:
    """A query in the dialect; `then` flattens nested results so that rows can be compared."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = Engine(spark, catalog(spark, sf_dir), **engine).frame(table, query)
        return then(df) if then else df

    QUERIES[name], SQL[name] = run, sql


def frame(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    """A query written as a function."""

    def add(run: Run) -> Run:
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return add


from larkspur.queries import changes, graph, reads, relations, requests, search, writes  # noqa: E402, F401
