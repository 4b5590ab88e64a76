"""Connected components of an edge table, by contraction over joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import written


def flattened(parents: DataFrame) -> DataFrame:
    """node, root with roots followed to their ends; every root is a node, those at an end are their own."""
    while True:
        onward = parents.select(F.col("node").alias("root"), F.col("root").alias("next"))
        jumped = written(parents.join(onward, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        parents = jumped.select("node", "root")
        if jumped.where("moved").isEmpty():
            return parents


def between(edges: DataFrame) -> DataFrame:
    """Each edge once, its lower end as a, without loops; written."""
    return written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct())


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of each node's component. `edges` has longs a and b; loops and repeats may occur.

    Each round joins every node to its least neighbour, if that is lower, and puts what is joined in one node's place:
    only edges between different ones go on, so a tight group is gone after a round or two. Tables are written between
    rounds; the driver sees whether any are left.
    """
    edges = between(edges.select("a", "b").where(F.col("a").isNotNull() & F.col("b").isNotNull()))
    labels = None
    while labels is None or not edges.isEmpty():
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        roots = flattened(ends.groupBy("node").agg(F.least("node", F.min("other")).alias("root")))
        if labels is None:
            labels = roots
        else:
            onward = roots.select(F.col("node").alias("root"), F.col("root").alias("next"))
            labels = written(labels.join(onward, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        at = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
        edges = between(edges.join(at("a"), "a").join(at("b"), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")))
    return labels
