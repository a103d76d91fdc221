"""Queries over the given tables, one per operator, with the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from petriflow.plans import box_queries, score_queries, stream_queries, table_queries

Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, tuple[Query, str | None]] = {**box_queries.QUERIES, **score_queries.QUERIES, **table_queries.QUERIES, **stream_queries.QUERIES}


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
