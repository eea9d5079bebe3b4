"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root): the smallest node that each node of ``edges`` (a, b) can reach.

    Both steps are a minimum per node, combined before its shuffle, and a join back on the node,
    so a node with very many neighbours is split by the adaptive join and never gathered. Each
    round is written to the shared folder. An empty edge table gives no rows.
    """
    pairs = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges",
    )
    seen = None
    while True:
        before, pairs = pairs, stored(_small_star(_large_star(pairs)), "edges")
        discard(before)
        # Stars and nothing else: no root is a leaf and each leaf has one root.
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _large_star(pairs: DataFrame) -> DataFrame:
    """Connect every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # Stored, so that the join stands between two plain shuffles and a hot node can be split.
    least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return (
        both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    )


def _small_star(pairs: DataFrame) -> DataFrame:
    """Connect a node and its smaller neighbours to the smallest of them."""
    least = stored(pairs.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = pairs.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()
