"""Deep autoencoder-like nonnegative factorization of a symmetric network (Ye et al., 2018), for networks of any number of vertices.

A is close to U1 U2 ... Up V, and V to (U1 ... Up)' A; neighbours have like columns of V. U1 and V have a row for each vertex and
are tables; U2 ... Up are as small as the layers' ranks. A round multiplies A twice with tables of such rows (a join and a
grouping); all else is done row by row, with sums of outer products as large as the ranks squared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from elutra.plans.stages import Rounds

#: Least denominator of a multiplicative update.
LEAST = 1e-12


def _start(seed: int, rank: int, salt: int) -> Column:
    """A vector in (0, 1] by hashes of the vertex and the place."""
    return F.array(*[(F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt), F.lit(k)), F.lit(1 << 20)) + 1) / float(1 << 20) for k in range(rank)])


def _times(m: DataFrame, rows: DataFrame, rank: int) -> DataFrame:
    """(id, p): the entries (i, j, v) times the rows (id, w)."""
    sums = [F.sum(F.col("v") * F.col("w")[k]) for k in range(rank)]
    return m.join(rows.select(F.col("id").alias("j"), "w"), "j").groupBy(F.col("i").alias("id")).agg(F.array(*sums).alias("p"))


def _rows(x: pd.Series) -> np.ndarray:
    return np.array(x.tolist(), float)


def _by_row(df: DataFrame, name: str, inputs: list[str], f) -> DataFrame:
    """``df`` with the column ``name``: f of the inputs' rows, many at once."""

    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series(list(f(*map(_rows, columns))))

    return df.withColumn(name, F.pandas_udf(run, "array<double>")(*inputs))


def _sums(df: DataFrame, pairs: list[tuple[str, str]]) -> list[np.ndarray]:
    """Sums over all rows of the outer products of the pairs of columns, added up in Spark; only these sums are collected."""
    names = sorted({x for pair in pairs for x in pair})

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: list = [0.0] * len(pairs)
        for batch in batches:
            of = {c: _rows(batch[c]) for c in names}
            total = [t + of[a].T @ of[b] for t, (a, b) in zip(total, pairs, strict=True)] if len(batch) else total
        for k, x in enumerate(total):
            if isinstance(x, np.ndarray):
                yield pd.DataFrame({"which": k, "at": np.arange(x.size), "across": x.shape[1], "x": x.ravel()})

    found = df.select(*names).mapInPandas(part, "which int, at int, across int, x double").groupBy("which", "at", "across").agg(F.sum("x").alias("x"))
    got = found.toPandas().sort_values(["which", "at"])
    return [x["x"].to_numpy().reshape(-1, x["across"].iloc[0]) for _, x in got.groupby("which")]


def deep_factors(m: DataFrame, layers: tuple[int, ...] = (32, 8), rounds: int = 100, penalty: float = 0.01, seed: int = 42) -> tuple[DataFrame, list[float]]:
    """((id, cluster, vector), losses): the fitted factors of a symmetric matrix (i, j, v), absent entries counting as zeros.

    ``cluster`` is the largest place of a vertex's column of V, the first of equal ones; ``vector`` is its rows of U1 ... Up and V,
    one after the other. The loss of each round never rises. Entries of nulls are left out, those of equal ends are added up.
    An empty table gives an empty one and no losses.
    """
    m = m.where("i is not null and j is not null and v is not null").groupBy("i", "j").agg(F.sum(F.col("v").cast("double")).alias("v"))
    tables, entries = Rounds(m.sparkSession), Rounds(m.sparkSession)
    m = entries.keep(m)
    square = m.agg(F.sum(F.col("v") * F.col("v"))).first()[0]
    first, last = layers[0], layers[-1]
    draw = np.random.default_rng(seed)
    small = [draw.uniform(LEAST, 1, (a, b)) for a, b in zip(layers, layers[1:], strict=False)]
    state = m.groupBy(F.col("j").alias("id")).agg(F.array(F.sum("v")).alias("d")).select("id", "d", _start(seed, first, 1).alias("u"), _start(seed, last, 2).alias("v"))
    state = tables.keep(state.join(_times(m, state.select("id", F.col("u").alias("w")), first).withColumnRenamed("p", "b"), "id"))
    losses: list[float] = []
    if square is None:
        return state.select("id", F.lit(0).alias("cluster"), F.concat("u", "v").alias("vector")), losses
    for _ in range(rounds):
        # U1: its numerator and denominator are products of rows with small matrices.
        (vv,) = _sums(state, [("v", "v")])
        phi = reduce(np.matmul, small, np.eye(first))
        ahead = _by_row(state, "w", ["v", "b"], lambda v, b, phi=phi: np.hstack([v, b @ phi]))
        new = state.join(_times(m, ahead.select("id", "w"), 2 * last), "id")
        new = _by_row(new, "u", ["u", "p"], lambda u, p, phi=phi, vv=vv: u * (2 * p[:, :last] @ phi.T) / np.maximum(u @ (phi @ vv @ phi.T) + p[:, last:] @ phi.T, LEAST))
        new = tables.keep(new.select("id", "d", "u", "v", F.slice("p", 1, last).alias("p")))
        new = tables.keep(new.join(_times(m, new.select("id", F.col("u").alias("w")), first).withColumnRenamed("p", "b"), "id"))
        # U2 ... Up, from sums alone.
        uu, bb, up, vp = _sums(new, [("u", "u"), ("b", "b"), ("u", "p"), ("v", "p")])
        for k in range(len(small)):
            before, after = reduce(np.matmul, small[:k], np.eye(first)), reduce(np.matmul, small[k + 1 :], np.eye(small[k].shape[1]))
            under = before.T @ uu @ before @ small[k] @ after @ vv @ after.T + before.T @ bb @ before @ small[k] @ after @ after.T
            small[k] = small[k] * (2 * before.T @ up @ after.T) / np.maximum(under, LEAST)
        phi = reduce(np.matmul, small, np.eye(first))
        spread = np.trace(_sums(new.withColumn("dv", F.transform("v", lambda x: x * F.col("d")[0])), [("v", "dv")])[0]) - np.trace(vp) if penalty else 0.0
        inner = (phi * up).sum()
        losses.append(square - 2 * inner + (phi.T @ uu @ phi * vv).sum() + np.trace(vv) - 2 * inner + np.trace(phi.T @ bb @ phi) + penalty * spread)
        # V: row by row.
        own = phi.T @ uu @ phi
        new = _by_row(new, "v", ["v", "b", "p", "d"], lambda v, b, p, d, phi=phi, own=own: v * (2 * b @ phi + penalty * p) / np.maximum(v @ own + v + penalty * d * v, LEAST))
        state = tables.keep(new.select("id", "d", "u", "v", "b"))
        tables.forget()
    phi = reduce(np.matmul, small, np.eye(first))
    out = _by_row(state, "x", ["u"], lambda u: u @ phi)
    top = (F.array_position("v", F.array_max("v")) - 1).cast("int")
    return out.select("id", top.alias("cluster"), F.concat("x", "v").alias("vector")), losses
