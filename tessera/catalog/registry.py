"""Registration of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.catalog.fixture import STORE_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, store: bool = False):
    """Registers (spark, sf_dir) -> DataFrame; with ``store`` the SQL may name the index's tables."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered already")
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = with_store(sql) if store else sql
        return f

    return register


def with_store(sql: str) -> str:
    body = sql.strip()
    return STORE_SQL + (", " + body[4:].lstrip() if body[:5].upper() == "WITH " else " " + body)
