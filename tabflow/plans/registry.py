"""Registry of named queries (``queries()``) and their DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}
HEADLINE: list[str] = []


def query(key: str, sql: str | None = None, headline: bool = False):
    def deco(fn):
        if key in QUERIES:
            raise KeyError(f"duplicate query {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        if headline:
            HEADLINE.append(key)
        return fn
    return deco


def r6(c: Column | str) -> Column:
    """Round doubles to 6 decimals on the Spark side (the SQL side uses round(x, 6))."""
    x = F.col(c) if isinstance(c, str) else c
    return F.round(x.cast("double"), 6)
