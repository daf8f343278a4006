"""Collects queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without ``sql`` only its rows are checked, and tests check the values."""

    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return register


def rounded(df: DataFrame, **places: int) -> DataFrame:
    """Round columns, since engines add doubles in different orders."""
    return df.withColumns({name: F.round(F.col(name).cast("double"), n) for name, n in places.items()})


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: F.col(name).cast("long") for name in names})


def r(expression: str, places: int = 4) -> str:
    """SQL for :func:`rounded`, without negative zero."""
    return f"(round(CAST({expression} AS DOUBLE), {places}) + 0.0)"
