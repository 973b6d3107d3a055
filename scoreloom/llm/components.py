"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.session import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # Apart from its aggregate, so that the join can be split where a node has many links.
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).hint("rebalance")
    return (
        both.filter("v > u")
        .join(least, "u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .filter("u != v")
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m")).hint("rebalance")
    to_least = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return to_least.unionByName(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component``, its least reachable node, for each node with a link.

    ``links`` has ``u`` and ``v``, numbers. Each round is written to the shared folder; the
    number of rounds grows with the logarithm of the longest chain. The joins are plain
    ones: adaptive execution splits a node with very many links.
    """
    edges = links.select("u", "v").filter("u != v").distinct()
    before = None
    while True:
        edges = written(_small_star(_large_star(edges)), "components")
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before or not state[0]:
            break
        before = state
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
