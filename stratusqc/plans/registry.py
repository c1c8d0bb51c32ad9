"""Collects the named queries of this package together with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query; without SQL only its rows can be checked."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def stamp(column: str | Column) -> Column:
    """Timestamp as text, the form in which results are compared."""
    col = F.col(column) if isinstance(column, str) else column
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")
