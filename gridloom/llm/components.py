"""Connected components by alternating large-star and small-star steps on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import cut, discard


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _is_final(state: DataFrame) -> bool:
    """Whether every node has one neighbour above it and those have none themselves: one pass over the nodes."""
    ends = state.select(F.col("u").alias("x"), F.lit(1).alias("lower")).unionByName(state.select(F.col("v").alias("x"), F.lit(0).alias("lower")))
    nodes = ends.groupBy("x").agg(F.sum("lower").alias("up"), F.min("lower").alias("least"))
    return nodes.where("up > 1 OR (up = 1 AND least = 0)").isEmpty()


#: Edges of a task: small tables stay in few files, however many partitions a shuffle has.
EDGES_A_TASK = 500_000


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v: long, u <> v) to a written table of ``id``, ``component`` (smallest id reachable); ids without an edge
    have no row.  Edges are computed once; the steps end when all trees are stars."""
    state = cut(edges)
    parts = 1 + state.count() // EDGES_A_TASK
    done = False
    while not done:
        before, state = state, cut(_small_star(_large_star(state.coalesce(parts)).coalesce(parts)), parts)
        discard(before)
        done = _is_final(state)
    out = cut(state.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(state.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()), parts)
    discard(state)
    return out
