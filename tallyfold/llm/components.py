"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import kept


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root): the smallest node of each node's component, from (a, b) edges.

    Nodes without an edge do not appear.  Every round is cut off by a checkpoint; rounds
    grow with the logarithm of the longest chain.
    """
    now = kept(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(rounds):
        # Large star: every larger neighbour of a node takes the least of the node and its neighbours.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).select(F.col("a").alias("n"), "m")
        large = both.filter("b > a").join(least.hint("merge"), F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # Small star: a node and its smaller neighbours take the least of these.
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        joined = large.join(least.hint("merge"), F.col("a") == F.col("n"))
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        now = kept(small)
        row = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
        if mark == (row["n"], row["s"]):
            break
        mark = (row["n"], row["s"])
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
