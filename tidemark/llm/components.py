"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import keep, release


def components(links: DataFrame) -> DataFrame:
    """node and label (the smallest node of its component) for every node of `links` (a, b), smallest ones left out.

    Every round hangs each node's neighbours on their smallest common neighbour. Only links are shuffled, minima are
    taken per task first, and each round is written out. Links of a node to itself are ignored.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    edges, before = keep(edges, "components"), None
    while True:
        both = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.min("lo").alias("m")).select("hi", F.least("hi", "m").alias("m"))
        large = both.join(least, "hi").filter("lo > hi AND lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct()
        roots = large.groupBy("hi").agg(F.min("lo").alias("m"))
        hung = large.join(roots, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        last, edges = edges, keep(hung.unionByName(roots.select("hi", F.col("m").alias("lo"))).distinct(), "components")
        release(last)
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(hi, lo))")).first()
        if now == before:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("label"))
        before = now
