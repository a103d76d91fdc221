"""Exact order statistics of groups of any size, several a group, without sorting a group or gathering its distinct values.

Selection by narrowing: a group's values are cut at a few values of its own (approximate percentiles around the wanted ranks, from a sketch of bounded
size), rows are counted between the cuts exactly, and only the stretches that hold a wanted rank are kept. A rank that falls on a cut is
settled, so repeated values cost nothing; the others are looked for in their stretch in the same way, until stretches are small enough to
be put in order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from petriflow.functions.joins import with_few
from petriflow.functions.lineage import checkpointed

#: Rows of a stretch that is put in order, at most.
SMALL_ROWS = 100_000
#: Accuracy of the first round's percentiles: the stretch around a wanted rank holds about 4 / ACCURACY of a group. Later rounds cut into so many parts.
ACCURACY, PARTS = 4_000, 32


def _stretches(rows: DataFrame, at: list[float]) -> DataFrame:
    """Rows (g, v) with _b, which stretch of their group they lie in: twice the cuts below v, and one more if v is a cut."""
    cuts = rows.groupBy("g").agg(F.array_distinct(F.percentile_approx("v", [min(max(p, 0.0), 1.0) for p in at], 2 * ACCURACY)).alias("_cuts"))
    joined = with_few(rows, cuts, "g")  # one row a group
    return joined.select("g", "v", (F.size(F.filter("_cuts", lambda c: c < F.col("v"))) + F.size(F.filter("_cuts", lambda c: c <= F.col("v")))).alias("_b"))


def _round(rows: DataFrame, wanted: DataFrame, at: list[float]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(settled (t, v), rows that are left, ranks that are left) of rows (g, v) and ranks (g, r from 0, t); a stretch is a group of the next round."""
    dealt = checkpointed(_stretches(rows, at))
    counts = dealt.groupBy("g", "_b").agg(F.count("*").alias("n"), F.first("v").alias("v"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = checkpointed(counts.withColumn("before", before))  # some rows a group and rank
    met = checkpointed(wanted.join(counts, "g").where("r >= before AND r < before + n"))
    settled = met.where("_b % 2 = 1").select("t", "v")
    inner = F.struct("g", "_b")
    left = met.where("_b % 2 = 0").select(inner.alias("g"), (F.col("r") - F.col("before")).alias("r"), "t", "n")
    kept = with_few(dealt, left.select("g.g", "g._b").distinct(), ["g", "_b"], "left_semi").select(inner.alias("g"), "v")
    return settled, kept, left


def select_ranks(rows: DataFrame, wanted: DataFrame, near: list[float] | None = None) -> DataFrame:
    """(t, v): of rows (g, v) the value of rank r (from 0, ascending) in group g, for every row (g, r, t) of ``wanted``, t being its name.

    ``near``: shares of a group near which its wanted ranks lie, if they do so in all groups. Ranks that a group does not have give no row; null values have no
    rank. A task sorts `SMALL_ROWS` of a group at most.
    """
    rows = rows.where("v IS NOT NULL")
    sizes = rows.groupBy("g").agg(F.count("*").alias("n"))
    left, settled = wanted.join(sizes, "g").select("g", "r", "t", "n"), []
    wide = 2 / ACCURACY
    at = sorted({p + e for p in near for e in (-wide, wide)}) if near else [i / PARTS for i in range(1, PARTS)]
    while True:
        left = checkpointed(left)
        most = left.agg(F.max("n")).first()[0]
        if most is None:
            break
        if most <= SMALL_ROWS:
            order = F.row_number().over(Window.partitionBy("g").orderBy("v")) - 1
            kept = with_few(rows, left.select("g").distinct(), "g", "left_semi")
            placed = kept.select("g", "v", order.alias("r"))
            settled.append(placed.join(left, ["g", "r"]).select("t", "v"))
            break
        done, rows, left = _round(rows, left.drop("n"), at)
        settled.append(done)
        at = [i / PARTS for i in range(1, PARTS)]
    return reduce(DataFrame.union, settled) if settled else wanted.join(rows, "g").where("false").select("t", "v")


def percentiles(df: DataFrame, value: str, shares: list[float], by: list[str] | None = None) -> DataFrame:
    """(by, p): the exact percentiles of each group at ``shares``, with straight lines between ranks; nulls play no part, a group without values has nulls."""
    by = by or []
    rows = df.select(F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(by)), F.lit(0).alias("z")).alias("g"), F.col(value).cast("double").alias("v"))
    sizes = checkpointed(rows.groupBy("g").agg(F.count("v").alias("n")))
    most = sizes.agg(F.max("n")).first()[0] or 0
    back = [F.col(f"g.k{i}").alias(c) for i, c in enumerate(by)]
    if most <= SMALL_ROWS:  # a group's values fit into one task
        out = rows.groupBy("g").agg(F.percentile("v", F.array(*(F.lit(p) for p in shares))).alias("p"))
        return out.select(*back, "p")
    at = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(p).alias("p")) for i, p in enumerate(shares))))
    spots = sizes.where("n > 0").select("g", "n", at.alias("a")).select("g", F.col("a.i").alias("i"), (F.col("a.p") * (F.col("n") - 1)).alias("x"))
    ranks = spots.select("g", "i", "x", F.explode(F.array_distinct(F.array(F.floor("x"), F.ceil("x")))).alias("r"))
    found = select_ranks(rows, ranks.select("g", "r", F.struct("g", "i", "x", "r").alias("t")), shares).select("t.*", "v")
    low, high = F.max(F.when(F.col("r") == F.floor("x"), F.col("v"))), F.max(F.when(F.col("r") == F.ceil("x"), F.col("v")))
    share = F.max("x") - F.floor(F.max("x"))
    each = found.groupBy("g", "i").agg(F.when(low == high, low).otherwise(low * (1 - share) + high * share).alias("v"))
    lists = each.groupBy("g").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("p"))  # one number a share
    return sizes.select("g").join(lists, "g", "left").select(*back, "p")
