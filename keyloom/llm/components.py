"""Connected components of a link table, without ever gathering links or nodes in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """links(a, b) -> node, component: the smallest node reachable, for every node that has a link to another.

    Alternates the large-star and small-star steps, which keep connectivity, shrink the longest path by a constant
    factor a round and end in stars around the smallest nodes. Each step joins the links with one minimum a node, so a
    node with very many links is a skewed join side that AQE splits, not a group. Null ends are dropped. The lineage
    is cut every round.
    """
    x, y = F.col(a), F.col(b)
    now = links.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()
    now = cut(now, "links")
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        if state["n"] == 0 or tuple(state) == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = tuple(state)
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        # Small star: every node's smaller neighbours, and the node, meet at the smallest of them.
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small, "u")
        now = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        now = cut(now.where(F.col("u") != F.col("v")).distinct(), "links")
