"""Connected components of an edge table, without the driver ever holding an edge.

Alternates large-star and small-star steps; each is a map-side combined minimum and an equi-join that adaptive
execution may split where one node has very many edges. The edge table is settled after each round. Each round that
changes it moves some edge to a smaller node, so it ends; rounds grow with the logarithm of the nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, settle


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: long) -> (node, root): root is the smallest node that node reaches; nodes without edges are absent."""
    both = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = settle(both, "edges")
    while True:
        # Large star: each neighbour that is greater than the node gets the least of node and neighbours.
        out = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = out.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = out.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: the node and its smaller neighbours get the least of these.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        new = settle(small, "edges")
        # A star forest: every a is there once, and no b is an a.
        stars = new.select(F.col("a").alias("n"), F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(new.select(F.col("b").alias("n"), F.lit(0).alias("l"), F.lit(1).alias("r")))
        bad = stars.groupBy("n").agg(F.sum("l").alias("l"), F.max("r").alias("r")).where("l > 1 or (l > 0 and r > 0)").limit(1).count()
        release(now)
        now = new
        if not bad:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
