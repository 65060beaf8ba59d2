"""Connected components of an edge table.

Alternating star contraction: in a large star every greater neighbour of a node moves
to the least one, in a small star every lesser one does, until each node hangs on its
root.  A hub's rows meet its least neighbour in a join whose sides are both plain
shuffles, so Spark can split a hub over several tasks; least neighbours are summed
before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B


def _with_least(near: DataFrame) -> tuple[DataFrame, DataFrame]:
    """u, v with m, the least of u and its neighbours; and u, m alone."""
    low = B.written(near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
    return near.join(low, "u"), low


def _star(edges: DataFrame) -> DataFrame:
    moved, large_low = _with_least(edges.union(edges.select("y", "x")).toDF("u", "v"))
    large = B.written(moved.where("v > u").select(F.col("v").alias("x"), F.col("m").alias("y")).where("x <> y").distinct())
    moved, small_low = _with_least(large.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")))
    out = B.written(moved.select(F.col("v").alias("x"), F.col("m").alias("y")).union(small_low.select("u", "m")).where("x <> y").distinct())
    B.discard(large_low, large, small_low)
    return out


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of all nodes that have an edge (x, y)."""
    state = B.written(edges.where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct())
    while True:
        before, state = state, _star(state)
        B.discard(before)
        # done when no parent is a child and every child has one parent
        twice = state.groupBy("x").agg(F.count("*").alias("n"), F.lit(False).alias("p")).union(state.select("y", F.lit(0).alias("n"), F.lit(True)).distinct())
        if not twice.groupBy("x").agg(F.sum("n").alias("n"), F.max("p").alias("p")).where("n > 1 OR (n > 0 AND p)").limit(1).count():
            break
    roots = state.select(F.col("y").alias("node")).distinct()
    return state.select(F.col("x").alias("node"), F.col("y").alias("component")).union(roots.select("node", F.col("node").alias("component")))
