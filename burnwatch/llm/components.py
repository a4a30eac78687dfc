"""Connected components of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnwatch.llm.staging import drop_staged, staged


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of the links (a, b): the smallest node that links lead to.

    In turn every node hangs its larger neighbours, then its smaller ones, below the smallest it knows; long chains halve, and a node with
    very many links is aggregated before it is shuffled. It ends when every node hangs below one root and roots hang below none. Links of a node with itself
    keep the node; nulls are dropped.
    """
    a, b = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    edges = staged(links.where("a IS NOT NULL AND b IS NOT NULL").select(a, b))
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v >= u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
        after = staged(small.select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).distinct())
        drop_staged(edges)
        edges = after
        # A star forest: each node once, and what a node hangs below hangs below itself.
        above = edges.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("v"))
        roots = edges.where("u = v").select(F.col("u").alias("v"))
        if above.where("n > 1").isEmpty() and edges.join(roots, "v", "left_anti").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
