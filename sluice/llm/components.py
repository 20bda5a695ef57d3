"""Connected components as DataFrame joins: hooking to the smallest neighbour, pointer jumping, contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import discard, stored

MOST_ROUNDS = 64


def roots(parents: DataFrame) -> DataFrame:
    """(node, root) of a forest (node, parent) in which every parent is smaller than its node; nodes that are only parents are left out."""
    now = stored(parents, "forest")
    for _ in range(MOST_ROUNDS):
        up = now.select(F.col("node").alias("parent"), F.col("parent").alias("_up"))
        before = now
        now = stored(now.select("node", "parent").join(up, "parent", "left").select("node", F.coalesce("_up", "parent").alias("parent"), F.col("_up").isNotNull().alias("_moved")), "forest")
        discard(before)
        if now.filter("_moved").isEmpty():
            break
    out = now.select("node", F.col("parent").alias("root"))
    out.stored_at = now.stored_at
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the ends of edges (a, b): root is the smallest node of its component.

    Each round hooks every node to its smallest neighbour, follows the hooks to
    their end and contracts; each component with an edge at least halves, so rounds
    are logarithmic. Every table is written in the shared folder. Loops and repeated
    edges are allowed; nulls are not.
    """
    both = edges.filter("a <> b").select("a", "b")
    left = stored(both.union(both.select("b", "a")).distinct(), "edges")
    labels = stored(left.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct(), "labels")
    for _ in range(MOST_ROUNDS):
        if left.isEmpty():
            discard(left)
            return labels
        forest = left.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent")).filter("parent < node")
        trees = roots(forest)
        to = trees.toDF("_from", "_to")
        before, edges = labels, left
        labels = stored(labels.join(to, labels["root"] == to["_from"], "left").select("node", F.coalesce("_to", "root").alias("root")), "labels")
        a, b = to.toDF("a", "_a"), to.toDF("b", "_b")
        left = stored(
            left.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")).filter("a <> b").distinct(), "edges"
        )
        discard(before, edges, trees)
    raise RuntimeError("components did not settle")
