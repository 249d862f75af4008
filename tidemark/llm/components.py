"""Connected components of links that stay in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _star(edges: DataFrame) -> tuple[DataFrame, int, int]:
    out = written(edges.distinct(), "links")
    row = out.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_003).alias("sum")).first()
    return out, row.n, row.sum or 0


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node it reaches) for every node of the links a, b.

    Rounds of large and small stars: every node links its larger neighbours, then its smaller ones, to the smallest
    node it knows. The minimum of each node's neighbours is aggregated before the shuffle, so a node with many links
    is no hot spot; each round is written to the shared folder, and the round before it deleted.
    """
    a, b = F.col("a"), F.col("b")
    edges, n, mark = _star(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    while True:
        both = edges.union(edges.select(b.alias("a"), a.alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
        large = both.where("b > a").join(low, "a").select(b.alias("a"), F.col("low").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("low"))
        small = down.join(low, "a")
        small = small.select(b.alias("a"), F.col("low").alias("b")).union(low.select("a", F.col("low").alias("b")))
        after, m, after_mark = _star(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
        discard(edges)
        if (m, after_mark) == (n, mark):
            break
        edges, n, mark = after, m, after_mark
    tops = after.select(b.alias("node"), b.alias("component")).distinct()
    return after.select(a.alias("node"), b.alias("component")).union(tops)
