"""Connected components of a link table, by alternating large and small stars
(Kiveris et al. 2014): every round is a few joins and aggregations, a vertex
with many links is never gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch, name: str = "stars") -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest
    node of its component (roots themselves are not listed)."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, k, before = scratch.table(edges, f"{name}-0"), 0, None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(low.select("a", F.col("m").alias("b"))).distinct())
        edges = scratch.table(small, f"{name}-{k + 1}")
        scratch.drop(f"{name}-{k}")
        k += 1
