"""Connected components of a graph that no single task holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noveltide.session import materialize


def _stars(edges: DataFrame) -> bool:
    """Whether every node is a child of one parent at most, and no parent is a child."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
    return not ends.groupBy("node").agg(F.sum("child").alias("c"), F.max("parent").alias("p")).where("c > 1 or (c = 1 and p = 1)").limit(1).count()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes of `edges` (a, b) that have another node as neighbour: the label is the component's smallest node.

    Large-star and small-star steps by turns: a node joins its larger neighbours to
    the smallest node it knows, then its smaller ones. This ends for every graph, in a
    number of rounds that grows with the square of the logarithm of its nodes at most. Smallest neighbours are taken per task before a shuffle,
    and joins read written tables on both sides, so adaptive execution splits hubs. Null ends have no links.
    """
    now = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = materialize(now, "edges")
    while not _stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")).select("w", F.least("w", "m").alias("m")), "least")
        now = materialize(both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        least = materialize(now.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")), "least")
        moved = now.join(least, F.col("u") == F.col("w")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(moved.unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct(), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
