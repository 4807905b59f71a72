"""Small helpers that several of the corpus operators use."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def short_batches(spark: SparkSession) -> None:
    """Texts may be long: Python tasks get them in batches of 1,000 rows and 16 MB at most."""
    for name, most in (("maxRecordsPerBatch", 1000), ("maxBytesPerBatch", 16 << 20)):
        spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the cluster's ``spark.checkpoint.dir``.

    Only where none is set, as in tests on one machine, is a temporary folder made.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (context.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


def stable(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, which cuts its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Up to so many rows of one or two numbers are broadcast.
FEW = 500_000


def small_side(df: DataFrame, most: int = FEW) -> DataFrame:
    """``df``, rows of one or two numbers, marked for a broadcast if it has at most ``most`` of them; else joins shuffle it."""
    return F.broadcast(df) if df.count() <= most else df


def per_batch(make: Callable[[], Callable[[list[str]], list[tuple]]], schema: str, names: list[str]) -> Callable[[Column], Column]:
    """A column function text -> struct. ``make`` runs once for each task and gives the function for a batch of texts.

    Null texts reach it as "". The function counts as nondeterministic, so that Spark never
    evaluates it a second time in a filter that it pushes down.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        all_of = make()
        for batch in batches:
            yield pd.DataFrame.from_records(all_of([x if isinstance(x, str) else "" for x in batch]), columns=names)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, schema).asNondeterministic()


def per_text(make: Callable[[], Callable[[str], tuple]], schema: str, names: list[str]) -> Callable[[Column], Column]:
    """Like ``per_batch``, with a function for one text."""

    def of_batch():
        one = make()
        return lambda texts: [one(x) for x in texts]

    return per_batch(of_batch, schema, names)
