"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbflow.llm.common import written


def contracted(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """The edges (a, b) between the roots of their ends; a node that ``roots`` lacks is its own."""
    for end in ("a", "b"):
        named = roots.select(F.col("node").alias(end), F.col("root").alias("of"))
        edges = edges.join(named, end, "left").withColumn(end, F.coalesce("of", end)).drop("of")
    return edges.where("a != b").distinct()


def merged(roots: DataFrame, over: DataFrame) -> DataFrame:
    """The components of nodes whose roots have components ``over`` them, and of nodes that ``over`` alone has."""
    up = over.select(F.col("node").alias("root"), F.col("root").alias("top"))
    held = roots.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return held.unionByName(over.join(roots, "node", "left_anti"))


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) of every node of the edges (a, b).

    In each round every node moves to its smallest neighbour, if that is smaller, and from
    there to the neighbour's own target; edges are then drawn between the targets.  Of two
    neighbours one always moves, so nodes at least halve; the smallest never moves.  Every
    round is written to the shared folder.
    """
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    roots = written(ends.select("node", F.col("node").alias("root")), "roots")
    live = written(edges.select("a", "b").where("a != b").distinct(), "edges")
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        moves = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("to"))
        next_ = moves.select(F.col("node").alias("to"), F.col("to").alias("root"))
        moves = written(moves.join(next_, "to").select("node", "root"), "moves")
        up = moves.select(F.col("node").alias("root"), F.col("root").alias("up"))
        roots = written(roots.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "roots")
        live = written(contracted(live, moves), "edges")
    return roots
