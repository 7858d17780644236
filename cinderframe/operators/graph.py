"""Connected components of a graph given as links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderframe.sources.scratch import written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each end of a link (a, b): the smallest node reachable.

    Every round a node and its larger neighbours link to its smallest neighbour, then a node and its
    smaller ones do; long chains shrink by a constant factor, so rounds are few whatever the shape.
    Each round is a written table, which cuts lineage and outlives executors. Rounds end when a
    table's number of links and two digests of them stay the same. The root of a giant component is
    one key of the joins, of whose two sides one has a single row for it: adaptive execution splits it.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = _digest(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = _digest(edges)
        if now == seen:
            ends = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return ends.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = now


def _digest(edges: DataFrame) -> tuple:
    """The number of links and two digests of their set."""
    digests = [F.bit_xor(F.xxhash64(F.lit(seed), "u", "v")) for seed in (1, 2)]
    return tuple(edges.agg(F.count("*"), *digests).first())
