"""Named queries and the SQL that gives the same answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query. Without SQL it is checked by row count and by its own tests."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def plain_zero(sql: str, *columns: str) -> str:
    """The same rows with negative zero written as zero, as rounding in Spark does."""
    fixed = ", ".join(f"CASE WHEN {c} = 0 THEN 0.0::DOUBLE ELSE {c} END AS {c}" for c in columns)
    return f"SELECT * REPLACE ({fixed}) FROM ({sql})"
