"""Connected components of a distributed edge list by repeated hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlark.llm.common import materialize


def relabel(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges between the labels of their ends, without loops and repeats; unlabelled nodes stay."""
    at_a = labels.select(F.col("node").alias("a"), F.col("label").alias("label_a"))
    at_b = labels.select(F.col("node").alias("b"), F.col("label").alias("label_b"))
    moved = edges.join(at_a, "a", "left").join(at_b, "b", "left").select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))
    return moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def to_roots(hooks: DataFrame) -> DataFrame:
    """Follow hooks (node to smaller node) until every label is a root, twice as far with every step."""
    while True:
        onward = hooks.select(F.col("node").alias("label"), F.col("label").alias("onward"))
        longer = hooks.join(onward, "label", "left").select("node", "label", "onward")
        if longer.where("onward IS NOT NULL").isEmpty():
            return hooks
        hooks = materialize(longer.select("node", F.coalesce("onward", "label").alias("label")), "hooks")


def components(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """node, label: the smallest node reachable, for every node whose label is not itself.

    ``labels`` are those of earlier edges, to which ``edges`` are added. Every step hooks each node
    to its smallest neighbour, follows hooks to their roots and contracts, so steps grow with the
    logarithm of the number of nodes. Minima are combined before the shuffle, so a hub is no hot spot.
    """
    if labels is None:
        labels = edges.sparkSession.createDataFrame([], "node long, label long")
    left = materialize(relabel(edges.select("a", "b"), labels), "edges")
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("b")).where("b < a")
        roots = to_roots(materialize(least.select(F.col("a").alias("node"), F.col("b").alias("label")), "hooks"))
        onward = roots.select(F.col("node").alias("label"), F.col("label").alias("onward"))
        older = labels.join(onward, "label", "left").select("node", F.coalesce("onward", "label").alias("label"))
        labels = materialize(older.unionByName(roots), "labels")
        left = materialize(relabel(left, roots), "edges")
    return labels
