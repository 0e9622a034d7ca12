"""Connected components by contracting edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources import discard
from .common import written


def components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a``, ``b``): root is the same in a component.

    Each round a node points to its smallest neighbour if that is smaller, pointers
    are followed once, and edges are rewritten to the ends of the pointers. Nodes
    without a smaller neighbour stay. The edges shrink with every round; none is left
    when every component is one node. Hot nodes are pre-aggregated by ``min``.
    """
    live = written(edges.where("a <> b").distinct(), "edges")
    placed = written(live.select(F.col("a").alias("node")).union(live.select("b")).distinct().withColumn("root", F.col("node")), "nodes")
    for _ in range(most_rounds):
        if live.isEmpty():
            discard(live)
            return placed
        both = live.union(live.select("b", "a"))
        nearest = both.groupBy(F.col("a").alias("root")).agg(F.min("b").alias("to")).where("to < root")
        onward = nearest.select(F.col("root").alias("to"), F.col("to").alias("beyond"))
        jumped = written(nearest.join(onward, "to", "left").select("root", F.coalesce("beyond", "to").alias("to")), "jumped")
        older, placed = placed, written(placed.join(jumped, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "nodes")
        a, b = (jumped.select(F.col("root").alias(c), F.col("to").alias(f"to_{c}")) for c in "ab")
        moved = live.join(a, "a", "left").join(b, "b", "left")
        moved = moved.select(F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b"))
        done, live = live, written(moved.where("a <> b").distinct(), "edges")
        discard(older, done, jumped)
    raise RuntimeError("components did not settle")
