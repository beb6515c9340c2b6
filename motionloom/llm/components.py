"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored


def _least(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Per `a`: the least of itself and its neighbours."""
    return edges.groupBy(a).agg(F.min(b).alias("least")).withColumn("least", F.least("least", a))


def large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the least of its neighbourhood."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least(both, "u", "v"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).filter("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("least"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.unionByName(least.select("u", F.col("least").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component: every node of an edge and the least node that it reaches.

    Edges are (u, v) in either direction, repeated or looped as they come. The number of rounds
    grows with the logarithm of the longest path; each round is written to the shared folder.
    """
    now = stored(edges.select("u", "v").filter("u <> v").distinct())
    seen = None
    while True:
        print_of = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if print_of == seen:
            break
        seen = print_of
        now = stored(small_star(large_star(now)))
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select("component", "component").toDF("node", "component")).distinct()
