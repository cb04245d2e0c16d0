"""Connected components of an edge list, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.functions.store import forget, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b), the root the smallest node reachable. Null ends are not allowed.

    Every round points each node to its smallest neighbour, follows the pointers to their end, and keeps the
    edges between different ends. The number of ends at least halves, so rounds grow with the logarithm of the
    nodes. All tables of a round are stored, and the joins are between stored tables, whose hot keys Spark splits.
    """
    current = stored(edges.where("a <> b").distinct(), "cc-edges")
    labels = None
    while not current.isEmpty():
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = stored(both.groupBy("a").agg(F.min("b").alias("_b")).select(F.col("a").alias("node"), F.least("a", "_b").alias("root")), "cc-parents")
        parents = flattened(parents)
        if labels is None:
            labels = parents
        else:
            old = labels
            labels = stored(moved(old, parents, "root").select("node", F.col("_to").alias("root")), "cc-labels")
            forget(old)
        ends = moved(current, parents, "a").select(F.col("_to").alias("a"), "b")
        ends = moved(ends, parents, "b").select("a", F.col("_to").alias("b")).where("a <> b").distinct()
        following = stored(ends, "cc-edges")
        forget(current)
        current = following
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root")).where(F.lit(False))


def moved(rows: DataFrame, parents: DataFrame, column: str) -> DataFrame:
    """Add `_to`: where the node in a column points to, itself if nowhere."""
    to = parents.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    joined = rows.join(to, F.col(column) == F.col("_node"), "left")
    return joined.withColumn("_to", F.coalesce("_root", column)).drop("_node", "_root")


def flattened(parents: DataFrame) -> DataFrame:
    """Follow all pointers to their ends, doubling the distance every time."""
    while True:
        further = stored(moved(parents, parents, "root").select("node", F.col("_to").alias("root"), (F.col("_to") != F.col("root")).alias("_moved")), "cc-jump")
        if further.where("_moved").isEmpty():
            return parents
        forget(parents)
        parents = further.drop("_moved")
