"""Connected components of an edge list by alternating large-star and small-star steps.

Every step is an aggregate and an equi-join, so a hub node is combined on the map side and its
edges can be split by the adaptive skew join. Nothing is collected but one count per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.session import staged


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    inner = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return inner.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges: (u, v) of one orderable type; self-loops and nulls are ignored, repeats allowed.

    Returns (u, v): each node that isn't the least of its component, and that least node.
    An empty edge list gives an empty frame.
    """
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, before = staged(now, "edges", shuffled=True), None
    for _ in range(max_rounds):
        after = staged(_small_star(_large_star(now)), "stars", shuffled=True)
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(mark) == before or mark[0] == 0:
            return after
        before, now = tuple(mark), after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
