"""Registry of named queries over the given tables and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under *name*, with the SQL that must give the same rows."""

    def add(function: Query) -> Query:
        if name in QUERIES:
            raise KeyError(f"query '{name}' is registered twice")
        QUERIES[name] = function
        if sql is not None:
            CHECKS[name] = sql
        return function

    return add


def r6(column: Column | str, name: str | None = None) -> Column:
    """Double rounded to six digits, for comparison across engines."""
    value = F.round(F.col(column) if isinstance(column, str) else column, 6)
    return value.alias(name or str(column)) if name or isinstance(column, str) else value


def big(column: Column | str, name: str | None = None) -> Column:
    """Count as bigint."""
    value = (F.col(column) if isinstance(column, str) else column).cast("bigint")
    return value.alias(name or str(column)) if name or isinstance(column, str) else value
