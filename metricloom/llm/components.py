"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.llm.common import release, stored


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node`` and ``root`` (the least node reachable) for every node of ``links(a, b)``.

    Alternating large and small stars. The least neighbour comes from an aggregate, which combines
    before the shuffle, and goes back to the links by a join, which Spark can split where one node has
    very many links; no list of neighbours is ever built. Each round is written to the shared folder.
    Links with a null end and loops are left out; with no links the result is empty.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u > v").distinct()
        # small star: the nodes at or below u, with u itself, move to the least of them
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        last, edges = edges, stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        release(last)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.max("u")).first()
        if now == before:
            roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
