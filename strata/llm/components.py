"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

MAX_ROUNDS = 60


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node of the group.

    Every round replaces a node's edges by edges to its smallest neighbour, in
    two groupings with partial sums and two joins that Spark can split, so a
    node of many edges is never gathered in one task.  Rounds are cut by
    checkpoint(); their number grows with the logarithm of the longest path.
    Null ends and self-loops are ignored."""
    now = (edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
           .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct().checkpoint())
    seen = None
    for _ in range(MAX_ROUNDS):
        # large star: neighbours above a node move to the smallest of its neighbourhood
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node and its neighbours below move to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(low, "u")
        now = (pairs.select(F.col("v").alias("u"), F.col("m").alias("v")).union(pairs.select("u", F.col("m").alias("v")))
               .where("u <> v").distinct().checkpoint())
        # stars no longer change: the count and the sum of hashes stand still
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
