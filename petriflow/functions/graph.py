"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petriflow.functions.lineage import checkpointed


#: Into how many parts a node's neighbours are dealt, so that no task holds all of a hub's.
SALTS = 8


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u > v). Each node's neighbours are linked to the least of them and itself.

    The least neighbour comes from partial minima, and meets the neighbours in ``SALTS`` parts of the node. Every edge gives one edge (and
    every node one in a small step), so edges that come twice are left to the end of a round.
    """
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    spread = least.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    linked = both.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(spread, ["u", "s"])
    if large:
        linked = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        linked = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return linked.where("u <> v")


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node has one link, to a node that has none: then each node is linked to the least of its component."""
    links = edges.groupBy("u").agg(F.count("*").alias("n"))
    middle = links.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select("u")
    return links.where("n > 1").select("u").union(middle).isEmpty()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) for every node of ``edges`` (u, v; long): component is the smallest id that it reaches.

    Both steps only group with partial minima and join on a part of a node's neighbours; no neighbourhood is gathered, and a hub's is
    dealt to several tasks. Each round is cut off from its lineage in the shared checkpoint folder. Self loops count as
    nodes; null ends are ignored.
    """
    nodes = edges.where("u = v").select(F.col("u").alias("id")).distinct()
    now = checkpointed(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(most_rounds):
        if _all_stars(now):
            break
        now = checkpointed(_star(_star(now, True), False).distinct())
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    found = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    alone = nodes.join(found.select("id").union(roots.select("id")), "id", "left_anti").select("id", F.col("id").alias("component"))
    return found.union(roots).union(alone)
