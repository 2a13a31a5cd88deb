"""Connected components of links, as joins and aggregations that keep every step in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from needledrop.llm.common import remove, written


def connected_components(links: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) for every node of links (a long, b long).

    Alternating stars (large star, then small star) until nothing changes: each node hangs its larger, then its smaller
    neighbours on the smallest node it sees. Both need one minimum for each node and one join back on that node, so a
    hub's links are never held together. Every round's links are a written table in the shared folder. Nulls and
    loops are left out: a node without another isn't in the result.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null and a <> b").distinct()
    edges, before = written(edges, "links"), None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        if not state[0]:
            break
        # Large star: over neighbours on both sides, larger ones move to the smallest.
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: over smaller neighbours, and the node itself.
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        moved = large.join(low, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        old, edges = edges, written(moved.union(low.select("k", "m")).distinct(), "links")
        remove(old)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
