"""Rows times a fixed list of parameters, and keys in all combinations, without a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_each(df: DataFrame, names: list[str], rows: list[tuple]) -> DataFrame:
    """``df`` once for each of ``rows``, whose values come in as columns ``names``. The list is the caller's and short."""
    if len(names) == 1:
        return df.select("*", F.explode(F.array(*(F.lit(r[0]) for r in rows))).alias(names[0]))
    return df.select("*", F.inline(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, r, strict=True))) for r in rows))))


def all_pairs_of_keys(df: DataFrame, a: str, b: str, as_a: str | None = None, as_b: str | None = None) -> DataFrame:
    """Every combination of the values of two columns of few values (clients, classes)."""
    sets = df.agg(F.array_sort(F.collect_set(a)).alias("_a"), F.array_sort(F.collect_set(b)).alias("_b"))
    return sets.select(F.explode("_a").alias(as_a or a), "_b").select(as_a or a, F.explode("_b").alias(as_b or b))
