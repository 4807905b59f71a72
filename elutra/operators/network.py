"""Networks as edge tables. An undirected edge is one row (src, dst, weight) with src < dst; absent edges have no row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from elutra.functions import names


def canonical(edges: DataFrame, order: str | None = None) -> DataFrame:
    """Undirected edges of (src, dst, weight); of repeated ones the last by ``order`` counts (the largest without one)."""
    last = F.max_by("weight", order) if order else F.max("weight")
    return edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(last.alias("weight"))


def symmetrize(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Both directions of every edge, weights of equal ones summed."""
    back = edges.select(*by, F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return edges.select(*by, "src", "dst", "weight").unionByName(back).groupBy(*by, "src", "dst").agg(F.sum("weight").alias("weight"))


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()


def replicate_table(edges: DataFrame, replicates: list, by: tuple[str, ...] = ()) -> DataFrame:
    """(src, dst, weight_0, ...): a column for each replicate, NULL where it lacks the edge. One shuffle."""
    wide = edges.groupBy(*by, "src", "dst").pivot("replicate", replicates).agg(F.max("weight"))
    return wide.select(*by, "src", "dst", *[F.col(f"`{r}`").alias(f"weight_{k}") for k, r in enumerate(replicates)])


def outer_max(wide: DataFrame) -> DataFrame:
    """(src, dst, weight): the largest of the replicates' weights, absent ones as 0."""
    columns = [F.coalesce(c, F.lit(0.0)) for c in wide.columns if c.startswith("weight_")]
    return wide.select("src", "dst", (F.greatest(*columns) if len(columns) > 1 else columns[0]).alias("weight"))


def combine(edges: DataFrame, n_replicates: int | str, mode: str = "max", by: tuple[str, ...] = ()) -> DataFrame:
    """One weight for each edge over its replicates: the largest, the mean or the product; absent ones count as 0.

    With ``by``, for each of its values; ``n_replicates`` may then be a column that has their number.
    """
    n_replicates = F.max(n_replicates) if isinstance(n_replicates, str) else n_replicates
    value: Column = {
        "max": F.max("weight"),
        "mean": F.sum("weight") / n_replicates,
        "product": F.when(F.count("*") < n_replicates, 0.0).otherwise(F.product("weight")),
    }[mode]
    return edges.groupBy(*by, "src", "dst").agg(value.alias("weight"))


def frequency(edges: DataFrame, n_replicates: int, floor: float = 0.5) -> DataFrame:
    """(src, dst, freq): the share of replicates in which the edge weighs ``floor`` or more."""
    return edges.groupBy("src", "dst").agg((F.count_if(F.col("weight") >= floor) / n_replicates).alias("freq"))


def desirability(freq: Column, prob: Column, w_freq: float = 0.5, w_prob: float = 1.0) -> Column:
    """Weighted geometric mean; 0 if either is 0."""
    mean = F.exp((w_freq * F.ln(freq) + w_prob * F.ln(prob)) / (w_freq + w_prob))
    return F.when((freq > 0) & (prob > 0), mean).otherwise(F.lit(0.0))


def edge_list(edges: DataFrame, floor: float = 0.5, by: tuple[str, ...] = ()) -> DataFrame:
    """(prot_a, prot_b, comb_prob, confidence) of edges from ``floor`` on, without self-loops."""
    kept = edges.where((F.col("src") != F.col("dst")) & (F.col("weight") >= floor))
    return kept.select(*by, F.col("src").alias("prot_a"), F.col("dst").alias("prot_b"), F.col("weight").alias("comb_prob"), names.confidence(F.col("weight")).alias("confidence"))


def neighbours(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(protein, interactors, n): the sorted neighbours of each vertex in one string, and how many."""
    both = symmetrize(edges, by).where("src <> dst")
    return both.groupBy(*by, F.col("src").alias("protein")).agg(F.array_join(F.array_sort(F.collect_set(F.col("dst").cast("string"))), ", ").alias("interactors"), F.count("*").alias("n"))


def cross_condition_max(edges: DataFrame, merge_scope: str = "last") -> DataFrame:
    """(src, dst, weight) over conditions: of the last one in order, or the largest weight over all."""
    if merge_scope == "last":
        last = edges.agg(F.max("cond").alias("cond"))
        edges = edges.join(F.broadcast(last), "cond")  # one row
    return edges.groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def prune(edges: DataFrame, floor: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Edges from ``floor`` on, and the vertices that still have one."""
    kept = edges.where(F.col("weight") >= floor)
    return kept, vertices(kept)


def drop_contaminants(edges: DataFrame, frequencies: DataFrame, threshold: float = 0.4) -> DataFrame:
    """Edges without an end whose frequency (gene, freq) among controls is ``threshold`` or more."""
    bad = frequencies.where(F.col("freq") >= threshold).select("gene")
    return edges.join(bad, edges["src"] == bad["gene"], "left_anti").join(bad, F.col("dst") == bad["gene"], "left_anti")
