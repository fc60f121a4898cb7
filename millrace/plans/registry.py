"""Named queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, folder of tables); sql is what DuckDB runs on the same tables."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def r(c: str | Column, digits: int = 4, name: str | None = None) -> Column:
    """Rounded, so that sums in another order compare equal; under the column's own name if it has one."""
    out = F.round(F.col(c) if isinstance(c, str) else c, digits)
    return out.alias(name or c) if name or isinstance(c, str) else out
