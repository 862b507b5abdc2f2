"""Connected components with alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from threadloom.session import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    """Connect every larger neighbour of a node to the smallest node around it.

    The minimum is a partial aggregate; the join back has one row per node on one side, so a node with very many
    neighbours is split by the adaptive skew join instead of being gathered.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    smallest = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
    return both.join(smallest, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("_m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Connect the smaller neighbours of a node, and the node, to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    smallest = down.groupBy("a").agg(F.min("b").alias("_m"))
    moved = down.join(smallest, "a").filter(F.col("b") != F.col("_m")).select(F.col("b").alias("a"), F.col("_m").alias("b"))
    return moved.unionByName(smallest.withColumnRenamed("_m", "b")).filter(F.col("a") != F.col("b")).distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")),
                    F.bit_xor(F.xxhash64("b", "a"))).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of an edge table ``(a, b)``; the label is the smallest node.

    Each round is written to the checkpoint folder, so a lost executor costs one round. Only three numbers per
    round reach the driver.
    """
    current = cut_lineage(edges.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _fingerprint(current)
    while True:
        after = cut_lineage(_small_star(_large_star(current)))
        seen = _fingerprint(after)
        if seen == mark:
            break
        current, mark = after, seen
    nodes = current.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return nodes.unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
