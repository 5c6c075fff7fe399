"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agorametric.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """Rows (node, root) for every node with a link; root is the smallest node of its component.

    `links` has two columns of longs, a and b. Each round hangs every node on the smallest node near it: first its
    larger neighbours, then its smaller ones. Rounds are logarithmic in the longest chain. A node with very many links
    is counted with map-side minima and joined, so it can be split over tasks. Each round is a stored table.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while (now := _print(edges)) != before:
        before = now
        edges = stored(_small_star(_large_star(edges)), "links")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def _print(edges: DataFrame):
    """Count and order-free hash of the links: equal prints mean that a round changed nothing."""
    mixed = F.xxhash64("a", "b")
    sums = [F.sum(F.shiftright(mixed, shift).bitwiseAND(F.lit(0xFFFFFFFF))) for shift in (0, 32)]
    return tuple(edges.agg(F.count("*"), *sums).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node hang on the smallest node of its neighbourhood."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least"))
    pairs = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("a", "least").alias("b"))
    return pairs.distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node, with its smaller neighbours, hangs on the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    moved = edges.join(least, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.union(least.select("a", F.col("least").alias("b"))).distinct()
