"""Connected components of a set of links, as DataFrame joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from elutra.llm.shared import stable


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b); component is the smallest node reachable.

    Alternates the large-star and small-star steps of Kiveris et al. (2014). Each step is a
    grouping whose minimum is combined before the shuffle, and a join on the same key; stars
    stay balanced as rows always point to smaller nodes. Nodes of any type that has an order.
    Links of a node with itself and nulls are ignored. An empty table gives an empty table.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = stable(edges)
    seen = None
    for _ in range(max_rounds):
        # Large star: every larger neighbour of u points to the smallest node around u.
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).union(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: u and its smaller neighbours point to the smallest of these.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        edges = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = stable(edges)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if seen is not None and tuple(now) == seen:
            break
        seen = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
