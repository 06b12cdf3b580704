"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014).

Every round is a map-combined minimum and a join; rounds grow with the logarithm of the longest path. Each ends in a
checkpoint in the shared folder, so lineage stays short and lost executors cost one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut


def _ordered(a: str, b: str) -> list:
    return [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): the least node each node is connected to. Nodes without an edge to another are not listed."""
    e = cut(edges.filter(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(*_ordered(src, dst)).filter("u <> v").distinct())
    before = None
    while True:
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = e.select(F.col("u").alias("a"), F.col("v").alias("b")).union(e.select("v", "u"))
        # materialised, so that adaptive execution can split the rows of a node with very many neighbours
        least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.join(least, "a").filter("b > a").select(*_ordered("b", "m")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(*_ordered("v", "m")).union(low.select("u", F.col("m").alias("v")))
        e = cut(small.filter("u <> v").distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
