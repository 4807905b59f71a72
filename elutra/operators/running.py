"""Running sums and minima over an ordered column, without one task for a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from elutra.plans.stages import keep


def in_ranges(df: DataFrame, by: list[str], x: str, ascending: bool = True) -> DataFrame:
    """``df`` with ``_bucket``: rows dealt by ranges of (by, x) of about equal size, numbered in order.

    Borders are quantiles that Spark samples from the rows, so buckets fit them however close together their values lie.
    They are written down with the rows, as another exchange could draw other borders.
    """
    dealt = df.repartitionByRange(*by, F.col(x).asc() if ascending else F.col(x).desc())
    return keep(dealt.withColumn("_bucket", F.spark_partition_id()))


def running(df: DataFrame, by: list[str], x: str, value: str, out: str, how: str = "sum", ascending: bool = True, strict: bool = False) -> DataFrame:
    """``df`` with ``out``: the sum or minimum of ``value`` over the rows of the same ``by`` whose ``x`` comes no later.

    ``x`` is distinct within ``by`` (group by it before). ``strict`` leaves the own row out. A scan of two levels: totals of ranges are
    put in order, a few rows for each group, and windows then run within ranges. Empty is 0 for sums, NULL for minima.
    """
    total = {"sum": F.sum, "min": F.min}[how]
    at = in_ranges(df, by, x, ascending)
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = at.groupBy(*by, "_bucket").agg(total(value).alias("_total")).withColumn("_before", total("_total").over(earlier)).drop("_total")
    order = F.col(x).asc() if ascending else F.col(x).desc()
    inside = Window.partitionBy(*by, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    joined = at.withColumn("_here", total(value).over(inside)).join(sums, [*by, "_bucket"])
    both: Column = F.coalesce("_before", F.lit(0)) + F.coalesce("_here", F.lit(0)) if how == "sum" else F.least("_before", "_here")
    return joined.withColumn(out, both).drop("_bucket", "_before", "_here")
