"""Sinks: Parquet between stages, and tab-separated reports."""

from __future__ import annotations

import dataclasses
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from elutra.operators.network import symmetrize


def write_tsv(df: DataFrame, path: str, header: bool = True, by: str | None = None) -> None:
    """With ``by``, a folder for each of its values; an earlier run's folders of other values stay."""
    writer = df.write.mode("overwrite")
    writer = writer.partitionBy(by).option("partitionOverwriteMode", "dynamic") if by else writer
    writer.option("sep", "\t").option("header", header).csv(path)


def wide_matrix(profiles: DataFrame, points: int = 72) -> DataFrame:
    """ID and a column for each place of the profile."""
    return profiles.select(F.col("key").alias("ID"), *[F.get("vals", F.lit(k)).alias(str(k)) for k in range(points)])


def pair_strings(pairs: DataFrame) -> DataFrame:
    """(ID, MB, FT): profiles as text, members apart by "#"."""
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return pairs.select(F.col("id").alias("ID"), F.col("mb").alias("MB"), F.concat_ws("#", text("fa"), text("fb")).alias("FT"))


def feature_strings(features: DataFrame) -> DataFrame:
    text = lambda c: F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit("nan"))), ",")
    return features.select(F.col("id").alias("ID"), F.col("mb").alias("MB"), text("cor").alias("COR"), F.col("shft").alias("SHFT"), text("dif").alias("DIF"), F.col("w").alias("W"))


def dense_adjacency(edges: DataFrame, ids: list) -> DataFrame:
    """One row and one column for each of ``ids``: for networks small enough to look at."""
    both = symmetrize(edges)
    return both.groupBy("src").pivot("dst", ids).agg(F.max("weight")).na.fill(0.0).orderBy("src")


def probability_table(wide: DataFrame) -> DataFrame:
    """Both directions of a table of replicates, in order of its keys."""
    rest = [c for c in wide.columns if c not in ("src", "dst")]
    back = wide.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)
    return wide.unionByName(back).orderBy(*[c for c in rest if not c.startswith("weight_")], "src", "dst")


def write_config(spark: SparkSession, config: object, path: str) -> None:
    """The run's settings as JSON, beside its results."""
    spark.createDataFrame([(json.dumps(dataclasses.asdict(config), sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
