"""All pairs by blocks, and null scores drawn by rows: what is sent or written doesn't grow with the square of the table; results are those of plain numpy."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from elutra.functions import md5
from elutra.operators import blocks, pairs, specificity


def test_profiles_are_sent_to_few_tasks(spark):
    """60 blocks of the least size would send every profile 60 times."""
    df = spark.range(600).select(F.col("id").alias("key"), F.array(F.rand(1), F.rand(2), F.rand(3)).alias("vals"))
    sent = blocks.dealt(df, block=10)
    assert sent.count() <= 600 * blocks.SPREAD and sent.select("key").distinct().count() == 600
    assert blocks.dealt(df, block=10, held=8 * 3 * 30).count() == 600 * 20  # beyond SPREAD only where blocks would be too large


def test_pairs_of_several_tiles_within_groups(spark, monkeypatch):
    monkeypatch.setattr(pairs, "TILE", 4)
    x = np.random.default_rng(8).random((90, 9))
    df = spark.createDataFrame([(f"g{i % 2}", f"k{i}", v.tolist()) for i, v in enumerate(x)], "g string, key string, vals array<double>")
    r = np.corrcoef(x)
    want = sorted((f"g{i % 2}", *sorted((f"k{i}", f"k{j}"))) for i in range(90) for j in range(i + 1, 90) if i % 2 == j % 2 and r[i, j] > 0.1)
    got = pairs.correlated_pairs(df, 0.1, 11, by="g").collect()
    assert sorted((row["g"], row["a"], row["b"]) for row in got) == want
    assert all(abs(row["r"] - r[int(row["a"][1:]), int(row["b"][1:])]) < 1e-12 for row in got)


def test_draws_take_the_first_allowed_pair_of_their_hashes(spark, monkeypatch):
    """Over several blocks and several rows of draws; no row lists all draws, and no draw is sent with profiles."""
    monkeypatch.setattr(pairs, "CHUNK", 16)
    x = np.random.default_rng(9).random((60, 9))
    x[7] = 0.5
    df = spark.createDataFrame([(f"k{i:02}", v.tolist()) for i, v in enumerate(x)], "key string, vals array<double>")
    with np.errstate(all="ignore"):
        r = np.corrcoef(x)
    number = lambda *text: int(hashlib.md5(":".join(map(str, text)).encode()).hexdigest()[:15], 16) % 60
    want = []
    for draw in range(100):
        tries = ((number(5, "i", draw, t), number(5, "j", draw, t)) for t in range(1000))
        want.append((draw, *next((f"k{i:02}", f"k{j:02}") for i, j in tries if i != j and r[i, j] <= 0.2)))
    assert sorted(tuple(row) for row in pairs.decoy_pairs(df, 100, 0.2, seed=5).select("draw", "a", "b").collect()) == want


@pytest.mark.parametrize("near", [0.003, 1e-6])
def test_null_cutoff_is_the_exact_quantile(spark, monkeypatch, near):
    """Also where the place is not among the scores first put in order. Scores are drawn without a table of all of them."""
    monkeypatch.setattr(specificity, "NEAR", near)
    monkeypatch.setattr(specificity, "DRAWN", 700)
    n, x = 1100, np.empty((301, 1100))
    for row in range(301):
        for j in range(n):
            h = hashlib.md5(f"3:{row}:{j}".encode()).hexdigest()
            u, v = ((int(h[k : k + 15], 16) + 0.5) / 2**60 for k in (0, 15))
            x[row, j] = np.exp(np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v))
    assert specificity.null_cutoff(spark, n, 300, 0.9, 3).first()[0] == pytest.approx(np.quantile(_scores(x), 0.9), rel=1e-12)
    assert np.sort(specificity.null_scores(spark, 40, 2, 3).toPandas()["value"]) == pytest.approx(np.sort(_scores(x[:3, :40]).ravel()), rel=1e-12)


def _scores(x):
    n, m = x.shape[1], x.mean(axis=1, keepdims=True)
    return x * np.maximum(1, np.sqrt(((x * x).sum(axis=1, keepdims=True) - n * m * m) / (n - 1)) / m)


def test_md5_of_many_texts():
    for prefix, first, last in (("0:3:", 0, 1101), ("12:10000:", 99990, 100020), ("0:7:", 9999999, 10000003)):
        want = [hashlib.md5(f"{prefix}{j}".encode()).hexdigest() for j in range(first, last)]
        high, low = md5.numbered(prefix, first, last)
        assert high.tolist() == [int(x[:15], 16) for x in want] and low.tolist() == [int(x[15:30], 16) for x in want]
