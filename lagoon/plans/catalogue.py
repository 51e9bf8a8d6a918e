"""Every query by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lagoon.plans import exact_queries, extra_queries, growth_queries, record_queries, stats_queries, stream_queries, value_queries

_PARTS = (stats_queries, record_queries, value_queries, extra_queries, exact_queries, growth_queries, stream_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for part in _PARTS for name, q in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.SQL.items()}
