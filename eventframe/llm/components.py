"""Connected components of a table of links, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventframe.llm.texts import work_table


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest one of its neighbourhood."""
    both = _both(edges)
    low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
    return both.join(low, "a").where("b > a").select(F.col("low").alias("a"), "b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.col("b").alias("n"), F.col("a").alias("m"))
    low = down.groupBy("n").agg(F.min("m").alias("low"))
    joined = down.join(low, "n")
    moved = joined.select(F.col("low").alias("a"), F.col("m").alias("b")).union(low.select(F.col("low").alias("a"), F.col("n").alias("b")))
    return moved.where("a < b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of every node with a link: the smallest node that can be reached.

    ``links`` has columns ``a`` and ``b`` in any order and number; loops are ignored. The
    rounds grow with the logarithm of the number of nodes; each is written to the shared
    folder, so no plan grows and a lost executor costs no earlier round. Neighbours are
    only aggregated to their minimum, never gathered.
    """
    ordered = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    edges, before = work_table(ordered, "links"), None
    while True:
        edges = work_table(_small(_large(edges)), "stars")
        # hashes of all links: equal sums mean that the round changed nothing
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if now == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
                edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
            )
        before = now
