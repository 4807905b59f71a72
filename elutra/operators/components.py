"""Connected parts of a network."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from elutra.plans.stages import Rounds


def components(edges: DataFrame, a: str = "i", b: str = "j") -> DataFrame:
    """(id, component) of every vertex of ``edges``: the least vertex that it is connected with. A vertex with only self-loops is a part of its own.

    Every round links what lies around a vertex to the least vertex there, first outwards, then inwards. Each is a minimum that
    tasks combine before they shuffle, and a join; the number of rounds grows with the logarithm of the network.
    """
    ids = edges.select(F.col(a).alias("id")).union(edges.select(F.col(b).alias("id"))).distinct()
    rounds = Rounds(edges.sparkSession)
    links = rounds.keep(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).distinct())
    before = None
    while True:
        ways = links.select(F.col("high").alias("at"), F.col("low").alias("to")).union(links.select(F.col("low").alias("at"), F.col("high").alias("to")))
        around = ways.groupBy("at").agg(F.least(F.min("to"), F.min("at")).alias("root"))
        outward = ways.where("to > at").join(around, "at").where("to <> root").select(F.col("to").alias("high"), F.col("root").alias("low")).distinct()
        below = outward.groupBy("high").agg(F.min("low").alias("root"))
        inward = outward.join(below, "high").where("low <> root").select(F.col("low").alias("high"), F.col("root").alias("low"))
        links = rounds.keep(inward.union(below.select("high", F.col("root").alias("low"))).distinct())
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first())
        rounds.forget()
        if now == before:
            break
        before = now
    return ids.join(links, F.col("id") == F.col("high"), "left").select("id", F.coalesce("low", "id").alias("component"))
