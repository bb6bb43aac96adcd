"""Connected components of an edge table, as joins and grouped minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwise.session import write_stage


def _symmetric(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Connect neighbours straight to the smallest node in reach: those above the node (large) or up to it (small)."""
    near = _symmetric(edges) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = near.join(low, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
    return out.where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b longs); label is the smallest node of its component.

    Alternates the large and the small star operation until nothing changes; every round is written to the
    shared folder and replaces the one before, so plans stay short and lost executors cost no more than a
    round. A node's neighbours are never gathered: each step is a grouped minimum and a join.
    """
    current = write_stage(edges.where("a != b").distinct(), "edges")
    while True:
        large = write_stage(_star(current.frame, True), "star")
        after = write_stage(_star(large.frame, False), "star")
        changed = after.frame.exceptAll(current.frame).limit(1).count() or current.frame.count() != after.frame.count()
        current.drop()
        large.drop()
        current = after
        if not changed:
            labels = current.frame.select(F.col("a").alias("node"), F.col("b").alias("label"))
            return labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())
