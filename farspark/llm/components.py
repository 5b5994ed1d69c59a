"""Connected components by contraction, without collecting links or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from farspark.operators.settle import settle


def components(links: DataFrame) -> DataFrame:
    """`node` and `root` for every end of a link (columns `a` and `b`); nodes share a root when links join them.

    Each round every node moves to its neighbour of least hash (or stays), links are redrawn between where their ends moved
    to, and those within one node go. A hash order leaves about half of the nodes of any graph, long chains included, so
    rounds grow with the logarithm of the largest component. Loops and null ends are no links; repeated links count once.
    """
    edges = settle(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    roots = None
    while not edges.isEmpty():
        order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("node"))
        ends = edges.select("a", "b").unionAll(edges.select(F.col("b"), F.col("a")))
        moves = settle(ends.groupBy("a").agg(F.min(order("b")).alias("near")).select(
            F.col("a").alias("node"), F.least(order("a"), "near")["node"].alias("to")))
        if roots is None:
            roots = moves.select("node", F.col("to").alias("root"))
        else:
            step = moves.select(F.col("node").alias("root"), "to")
            roots = settle(roots.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        first = moves.select(F.col("node").alias("a"), F.col("to").alias("_a"))
        second = moves.select(F.col("node").alias("b"), F.col("to").alias("_b"))
        moved = edges.join(first, "a").join(second, "b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
        edges = settle(moved.filter("a < b").distinct())
    return roots if roots is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
