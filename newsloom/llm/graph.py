"""Connected components of an undirected graph whose edges are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, redealt, stored


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): the least node that each node of an edge reaches; edges have columns u and v.

    Alternating large-star and small-star steps (Kiveris et al. 2014): edges stay linear in number. Each step is a least neighbour by node,
    partially aggregated, and a plain join of edges with it, both sides dealt anew by node, so Spark's adaptive join
    splits the edges of a node that has many. Steps are written to the shared folder until nothing changes; those before the last are deleted.
    """

    def low(e: DataFrame) -> DataFrame:
        return redealt(e.groupBy("u").agg(F.min("v").alias("m")), "u")

    now = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), name)
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(low(both).select("u", F.least("u", "m").alias("m")), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.join(low(large), "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        last, now = now, stored(small, name)
        dropped(last)
        r = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (r["n"], r["s"]) == before:
            break
        before = (r["n"], r["s"])
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())
