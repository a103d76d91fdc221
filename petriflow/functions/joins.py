"""Joins with tables of few rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petriflow.functions.lineage import checkpointed

#: Rows of a table that is sent to all executors, at most.
FEW_ROWS = 20_000


def with_few(rows: DataFrame, table: DataFrame, on: list[str] | str, how: str = "inner") -> DataFrame:
    """``rows`` joined with an aggregated table, which is counted first and broadcast where it has `FEW_ROWS` at most.

    The planner doesn't do so by itself: where keys are few, most partitions are empty, and it sorts all rows of a key in one task.
    """
    table = checkpointed(table)
    return rows.join(F.broadcast(table) if table.limit(FEW_ROWS + 1).count() <= FEW_ROWS else table, on, how)
