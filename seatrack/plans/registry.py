"""All queries over the given tables, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import box_queries, record_queries, table_queries, track_queries

_ENTRIES = {**track_queries.ENTRIES, **table_queries.ENTRIES, **record_queries.ENTRIES, **box_queries.ENTRIES}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in _ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    """Queries that SQL cannot express, such as clipped regions, have none and are held by tests."""
    return {name: sql for name, (_, sql) in _ENTRIES.items() if sql}
