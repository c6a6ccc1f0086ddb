"""Connected components of a graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def components(edges: DataFrame, keep) -> DataFrame:
    """(node, component) for the nodes of the edges (a, b); component is the smallest node reachable. Alternates the large-star
    and the small-star step until nothing changes; ``keep`` cuts the lineage of each round. A step groups by node only through
    a minimum, which Spark combines before the shuffle."""
    edges = keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct())
    size = edges.count()
    seen = None
    while size:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b")
                 .union(low.select("a", F.col("m").alias("b"))).distinct())
        edges = keep(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
