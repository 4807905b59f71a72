"""Hand-worked values of the profile expressions and kernels."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from elutra.functions import names, signal
from elutra.functions import profiles as p


def value(spark, column, **arrays):
    row = spark.createDataFrame([tuple(arrays.values())], ", ".join(f"{k} {'array<double>' if isinstance(v, list) and (not v or isinstance(v[0], float)) else 'array<int>' if isinstance(v, list) else 'string' if isinstance(v, str) else 'double'}" for k, v in arrays.items()))
    return row.select(column().alias("x")).first()["x"]


def test_gap(spark):
    assert value(spark, lambda: p.impute_gap(F.col("a")), a=[0.0, 2.0, 0.0, 4.0, 0.0, 0.0]) == [0, 2, 3, 4, 0, 0]


def test_resample(spark):
    got = value(spark, lambda: p.resample(F.col("a")), a=[0.0, 1.0, 2.0])
    assert got == pytest.approx([min(j / 24, 2.0) for j in range(72)])


@pytest.mark.parametrize("v", [[2.0, 4.0, 6.0], [5.0, 5.0]])
def test_minmax(spark, v):
    assert value(spark, lambda: p.minmax(F.col("a")), a=v) == ([0, 0.5, 1] if v[0] == 2 else [0, 0])


def test_normalize_stays_in_range(spark):
    got = value(spark, lambda: p.normalize(F.col("a")), a=[0.0, 3.0, 0.0, 9.0, 1.0, 0.5, 7.0])
    assert len(got) == 72 and min(got) == 0 and max(got) == 1


def test_smooth_keeps_constant(spark):
    assert value(spark, lambda: p.smooth(F.col("a")), a=[2.0] * 6) == pytest.approx([2.0] * 6)


@pytest.mark.parametrize("a,b,want", [([3, 9], [5, 20], 2), ([3, 9], [9], 0), ([], [4], None)])
def test_peak_shift(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a array<int>, b array<int>")
    assert df.select(p.peak_shift(F.col("a"), F.col("b")).alias("x")).first()["x"] == want


def test_abs_diff(spark):
    assert value(spark, lambda: p.abs_diff(F.col("a"), F.col("b")), a=[0.2, 1.0], b=[0.5, 0.0]) == pytest.approx([0.3, 1])


def test_pearson_of_a_constant_is_null(spark):
    assert value(spark, lambda: p.pearson(F.col("a"), F.col("b")), a=[1.0, 1.0, 1.0], b=[1.0, 2.0, 3.0]) is None
    assert value(spark, lambda: p.pearson(F.col("a"), F.col("b")), a=[1.0, 2.0, 4.0], b=[1.0, 2.0, 4.0]) == pytest.approx(1)


def test_fwhm(spark):
    assert value(spark, lambda: p.fwhm(F.col("a")), a=[0.0, 0.6, 1.0, 0.7, 0.1]) == 2
    assert value(spark, lambda: p.fwhm(F.col("a")), a=[0.0, 0.0]) is None


def test_fill_zero(spark):
    assert value(spark, lambda: p.fill_zero(F.col("a")), a=[1.0, float("nan"), 2.0]) == [1, 0, 2]


@pytest.mark.parametrize("x,want", [([0, 0.1, 0.5, 1, 0.5, 0.1, 0], [3]), ([0, 1, 0], []), ([0, 0.5, 1, 1, 0.5, 0], [2]), ([1.0] * 5, []), ([0.0] * 5, [])])
def test_find_peaks(x, want):
    assert [q for q, _, _ in signal.find_peaks(np.array(x, float))] == want


def test_sliding_pearson_against_numpy():
    rng = np.random.default_rng(1)
    a, b = rng.random((3, 72)), rng.random((3, 72))
    a[0, 20:40] = 0.5
    got = signal.sliding_pearson(a, b)
    for i in range(3):
        for n in range(63):
            if np.ptp(a[i, n : n + 10]) == 0:
                assert np.isnan(got[i, n])
            else:
                assert got[i, n] == pytest.approx(np.corrcoef(a[i, n : n + 10], b[i, n : n + 10])[0, 1])
    assert np.isnan(got[:, 63:]).all()


@pytest.mark.parametrize("k", [2, 3, 4])
def test_closest_peaks_equal_an_enumeration(k):
    """The least sum over all pairs, not over neighbours; beyond the steps the place of least spread decides."""
    draw = random.Random(k)
    for _ in range(200):
        peaks = [sorted(draw.sample(range(70), draw.randrange(1, 5))) for _ in range(k)]
        total = lambda c: sum(abs(a - b) for a, b in itertools.combinations(c, 2))
        least = min(map(total, itertools.product(*peaks)))
        found = signal.closest(peaks, 10**6)
        assert total(found) == least and all(p in own for p, own in zip(found, peaks, strict=True))
        if (short := signal.closest(peaks)) is not None:
            assert short == found
        if not set(peaks[0]).intersection(*peaks[1:]):
            assert signal.align(peaks) == (short or signal.least_spread(peaks))


def test_ties_and_limits_of_alignment():
    assert signal.closest([[0], [5], [9, 1]]) == [0, 5, 1]  # 0, 5, 9 are as close as 0, 5, 1 by neighbours only
    assert signal.closest([[10], [8, 12]]) == [10, 12]  # of equal sums the last one put in
    wide = [list(range(0, 120, 2)), list(range(1, 121, 2))]
    assert signal.closest(wide) is not None and signal.closest(wide, 60) is None
    assert signal.align(wide, 60) == signal.least_spread(wide) == [0, 1]
    assert signal.least_spread([[1, 9], [5], [4, 8]]) == [1, 5, 4]


def test_align():
    assert signal.align([[3, 9], [9, 20]]) == [9, 9]
    assert signal.align([[3, 9], [5, 20]]) == [3, 5]
    assert signal.align([[3], []]) is None


def test_als_at_half_is_one_solve():
    y = np.random.default_rng(2).random(30)
    d = np.diff(np.eye(30), 2, axis=0)
    assert signal.als_smooth(y) == pytest.approx(np.linalg.solve(0.5 * np.eye(30) + 10 * d.T @ d, 0.5 * y))


def test_isolate():
    x = np.array([0.2, 0.1, 0.5, 1.0, 0.4, 0.6, 0.1])
    assert signal.isolate(x, 3, 1, 6).tolist() == [0, 0.1, 0.5, 1.0, 0, 0, 0]


@pytest.mark.parametrize("x,want", [(0.95, "High"), (0.9, "Medium"), (0.75, "Low"), (0.5, "Low"), (0.49, "No interaction")])
def test_confidence(spark, x, want):
    assert value(spark, lambda: names.confidence(F.col("a")), a=x) == want


@pytest.mark.parametrize("x,want", [("A_p_0", "A"), ("A_p_10", "A0"), ("A", "A")])
def test_strip_peak_suffix(spark, x, want):
    assert value(spark, lambda: names.strip_peak_suffix(F.col("a")), a=x) == want
