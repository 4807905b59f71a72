"""Deep factorization against the same updates on dense arrays."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from elutra.operators import factors


def planted(n: int) -> np.ndarray:
    rng = np.random.default_rng(5)
    same = (np.arange(n)[:, None] * 4 // n) == (np.arange(n)[None] * 4 // n)
    a = np.triu(np.where(rng.random((n, n)) < np.where(same, 0.7, 0.03), rng.uniform(0.5, 1, (n, n)), 0.0), 1)
    return a + a.T


def dense(a, u, small, v, rounds, penalty):
    """Losses and factors of the published rules on whole matrices; ``v`` has a row for each vertex."""
    losses, d = [], a.sum(axis=0)[:, None]
    chain = [u, *small]
    for _ in range(rounds):
        for k in range(len(chain)):
            before = np.linalg.multi_dot([np.eye(len(a)), *chain[:k]]) if k else np.eye(len(a))
            after = np.linalg.multi_dot([np.eye(chain[k].shape[1]), *chain[k + 1 :]]) if k + 1 < len(chain) else np.eye(chain[k].shape[1])
            under = before.T @ before @ chain[k] @ after @ v.T @ v @ after.T + before.T @ a @ a.T @ before @ chain[k] @ after @ after.T
            chain[k] = chain[k] * (2 * before.T @ a @ v @ after.T) / np.maximum(under, factors.LEAST)
        whole = np.linalg.multi_dot(chain)
        losses.append(((a - whole @ v.T) ** 2).sum() + ((v.T - whole.T @ a) ** 2).sum() + penalty * np.trace(v.T @ (np.diag(d[:, 0]) - a) @ v))
        v = v * (2 * a.T @ whole + penalty * a @ v) / np.maximum(v @ whole.T @ whole + v + penalty * d * v, factors.LEAST)
    return losses, np.hstack([np.linalg.multi_dot(chain), v])


@pytest.mark.parametrize("penalty", [0.0, 0.1])
def test_equals_a_dense_fit(spark, penalty):
    """A hundred vertices: the same losses, never rising, the same factors; clusters are the planted groups."""
    a, layers, rounds = planted(100), (8, 4), 6
    i, j = np.nonzero(a)
    m = spark.createDataFrame([(int(x), int(y), float(a[x, y])) for x, y in zip(i, j)], "i long, j long, v double")
    got, losses = factors.deep_factors(m, layers, rounds, penalty)
    rows = {r["id"]: r for r in got.collect()}
    ids = spark.range(100)
    starts = {r["id"]: r for r in ids.select("id", factors._start(42, 8, 1).alias("u"), factors._start(42, 4, 2).alias("v")).collect()}
    small = [np.random.default_rng(42).uniform(factors.LEAST, 1, (8, 4))]
    want, vectors = dense(a, np.array([starts[k]["u"] for k in range(100)]), small, np.array([starts[k]["v"] for k in range(100)]), rounds, penalty)
    assert losses == pytest.approx(want, rel=1e-9)
    assert all(y <= x * (1 + 1e-12) for x, y in zip(losses, losses[1:]))
    assert np.allclose([rows[k]["vector"] for k in range(100)], vectors, rtol=1e-7)
    assert all(rows[k]["cluster"] == int(np.argmax(vectors[k, 4:])) for k in range(100))


def test_odd_entries(spark):
    """Nulls are left out, repeated entries added up; no entries give no vertices."""
    m = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0), (None, 2, 1.0), (3, None, 1.0), (1, 2, None)], "i long, j long, v double")
    got, losses = factors.deep_factors(m, (3, 2), 2)
    assert sorted(r["id"] for r in got.collect()) == [1, 2] and len(losses) == 2
    empty, losses = factors.deep_factors(m.where(F.lit(False)), (3, 2), 2)
    assert empty.count() == 0 and losses == []
