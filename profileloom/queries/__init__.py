"""Registered queries of the library, and SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name; sql is None where SQL can't state the result."""

    def register(f: Query) -> Query:
        _queries[f.__name__] = f, sql
        return f

    return register


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def queries() -> dict[str, Query]:
    from profileloom.queries import catalogs, generated, profiles, rollups  # noqa: F401

    return {name: f for name, (f, _) in _queries.items()}


def oracle_sql() -> dict[str, str]:
    queries()
    return {name: sql for name, (_, sql) in _queries.items() if sql}
