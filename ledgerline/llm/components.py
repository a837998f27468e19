"""Connected components of a stored edge table by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b of long); root is its component's smallest node.

    Each round points every node's larger neighbours, then its smaller ones, to
    the smallest node it knows (two joins on the node, whose hot keys adaptive
    execution splits). Rounds are stored; they end when the edges stay the same,
    after a number that grows with the logarithm of the longest path.
    """
    edges = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    before = None
    while True:
        seen = Observation()
        edges = stored(edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")), "edges")
        now = seen.get
        if now == before or not now["n"]:
            break
        before = now
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a").where("b != least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        edges = small.union(least).where("a != b").distinct()
    # now every node has one edge, to its root
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
