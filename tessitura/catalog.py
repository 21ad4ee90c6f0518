"""Registry of the library's queries and of their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``, with SQL that must return the same rows."""

    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


from .plans import array_queries, melody_queries, note_queries, pattern_queries, series_queries, stream_queries, table_queries, window_queries  # noqa: E402, F401  they register themselves
