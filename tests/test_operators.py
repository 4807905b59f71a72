"""Pairs, error control, networks, specificity and clusters on small tables with known results."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from elutra.operators import cluster, fdr, features, network, pairs, specificity
from elutra.operators.running import in_ranges, running
from elutra.plans import pipeline
from elutra.plans.config import RunConfig
from elutra.sources import tables, validate


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_correlated_pairs_in_blocks(spark):
    rng = np.random.default_rng(3)
    x = rng.random((40, 12))
    x[5] = 1.0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "key long, vals array<double>")
    with np.errstate(all="ignore"):
        r = np.corrcoef(x)
    want = sorted((i, j) for i in range(40) for j in range(i + 1, 40) if r[i, j] > 0.2)
    for block in (7, 1000):
        assert rows(pairs.correlated_pairs(df, 0.2, block), "a", "b") == want


@pytest.mark.parametrize("threshold", [0.1, -0.55])
def test_decoys_are_as_many_as_asked(spark, threshold):
    """Also where hardly any pair is allowed, so that the last draws come from a list of all of them."""
    x = np.random.default_rng(4).random((20, 12))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "key long, vals array<double>")
    r = np.corrcoef(x)
    assert (r <= threshold).any()
    found = rows(pairs.decoy_pairs(df, 50, threshold), "draw", "a", "b")
    assert [d for d, _, _ in found] == list(range(50)) and all(a != b and r[a, b] <= threshold for _, a, b in found)
    assert found == rows(pairs.decoy_pairs(df.repartition(7), 50, threshold), "draw", "a", "b")


def test_no_decoys_where_all_pairs_correlate(spark):
    df = spark.createDataFrame([(i, [float(i), 2.0 * i + 1, 3.0 * i + 5]) for i in range(1, 6)], "key long, vals array<double>")
    assert pairs.decoy_pairs(df, 5, -1.1).count() == 0 and pairs.decoy_pairs(df, 0).count() == 0


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_numbers_of_wide_rows(spark, adaptive):
    """Every row is there once, numbered in order, whatever borders an exchange draws."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        wide = spark.range(200_000, numPartitions=7).select(F.xxhash64("id").alias("key"), F.transform(F.sequence(F.lit(1), F.lit(72)), lambda k: k * F.rand(3)).alias("vals"))
        got = pairs.number(wide, "key")
        n, low, high, kinds = got.agg(F.count("*"), F.min("row"), F.max("row"), F.count_distinct("row")).first()
        assert (n, low, high, kinds) == (200_000, 0, 199_999, 200_000)
        assert got.join(got.select((F.col("row") + 1).alias("row"), F.col("key").alias("before")), "row").where("before > key").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_quantile_is_exact(spark):
    x = np.random.default_rng(7).lognormal(size=5000)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double")
    for q in (0.0, 0.37, 0.9, 1.0):
        assert specificity.quantile(df, "v", q).first()["v"] == pytest.approx(np.quantile(x, q), rel=1e-12)
    assert specificity.quantile(df.limit(0), "v", 0.5).first()["v"] is None
    assert specificity.quantile(df.where("v is null or v > 0").limit(1), "v", 0.5).count() == 1


def test_pair_table_numbers(spark):
    a = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    d = spark.createDataFrame([(2, 3)], "a long, b long")
    prior = spark.createDataFrame([(4, 4), (5, 6)], "a long, b long")
    got = rows(pairs.pair_table(a, d, prior), "id", "mb")
    assert got == [("DECOY_ppi_4", "2_DECOY#3_DECOY"), ("ppi_1", "1#2"), ("ppi_2", "1#3"), ("ppi_4", "5#6")]


def test_running_matches_plain_sums(spark):
    x = [(s, float(v), i + 1) for s in "ab" for i, v in enumerate(np.random.default_rng(5).random(50))]
    df = spark.createDataFrame(x, "sample string, x double, n int")
    for up, strict in ((True, False), (False, True)):
        got = {(r["sample"], r["x"]): r["out"] for r in running(df, ["sample"], "x", "n", "out", ascending=up, strict=strict).collect()}
        for s, v, _ in x:
            assert got[s, v] == sum(n for t, w, n in x if t == s and ((w < v if up else w > v) or (w == v and not strict)))


def test_stored_and_built_networks_score_alike(spark, tmp_path):
    """Layers written and read give the scores of those in memory and of plain products; what doesn't fit is refused."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 5))
    one = features.Layers([(rng.normal(size=(5, 7)), rng.normal(size=7), "relu"), (rng.normal(size=(7, 3)), rng.normal(size=3), "tanh"), (rng.normal(size=(3, 1)), rng.normal(size=1), "sigmoid")])
    (a, b, _), (c, d, _), (e, f, _) = one.layers
    want = 1 / (1 + np.exp(-(np.tanh(np.maximum(x @ a + b, 0) @ c + d) @ e + f)))
    one.save(spark, f"{tmp_path}/model")
    again = features.Layers.load(spark, f"{tmp_path}/model")
    assert np.allclose(one.score_batch(x), want[:, 0]) and (again.score_batch(x) == one.score_batch(x)).all()
    df = spark.createDataFrame([(f"p{k}_x", f"q{k}", k % 2 == 0, v.tolist()) for k, v in enumerate(x)], "a string, b string, is_decoy boolean, x array<double>")
    got = {r["prot_b"]: r["prob"] for r in features.score(df, again).collect()}
    assert got == pytest.approx({f"q{k}": v for k, v in enumerate(want[:, 0])})
    fitted = features.Logistic(rng.normal(size=5), 0.3)
    assert np.allclose(fitted.layers().score_batch(x), fitted.score_batch(x))
    for wrong in ([], [(np.ones((5, 2)), np.ones(2), "relu")], [(np.ones((5, 2)), np.ones(2), "relu"), (np.ones((3, 1)), np.ones(1), "relu")], [(np.ones((5, 1)), np.ones(1), "odd")]):
        with pytest.raises(ValueError):
            features.Layers(wrong)
    assert pipeline.scorer_of(df, RunConfig(scorer="stored", model=f"{tmp_path}/model")).score_batch(x) == pytest.approx(want[:, 0])


def test_ranges_fit_values_that_lie_close_together(spark):
    """All scores within 1e-4, most of them of one sample: ranges are still about equal, and sums right."""
    names = ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")
    before = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], "false")
    spark.conf.set(names[1], "16")
    try:
        n = 40_000
        df = spark.range(n).select(F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("sample"), (0.5 + F.col("id") * 1e-4 / n).alias("x"), (F.col("id") % 7).alias("n"))
        counts = [r["count"] for r in in_ranges(df, ["sample"], "x").groupBy("_bucket").count().collect()]
        assert len(counts) >= 12 and max(counts) < 3 * n / 16
        for up in (True, False):
            got = running(df, ["sample"], "x", "n", "out", ascending=up)
            want = df.toPandas().sort_values("x", ascending=up)
            want["out"] = want.groupby("sample")["n"].cumsum()
            assert got.toPandas().sort_values(["sample", "x"])["out"].tolist() == want.sort_values(["sample", "x"])["out"].tolist()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


@pytest.fixture
def scored(spark):
    return spark.createDataFrame([("s", v, False) for v in (0.9, 0.8, 0.7, 0.6)] + [("s", v, True) for v in (0.85, 0.65, 0.5)], "sample string, score double, is_decoy boolean")


def test_error_control(scored):
    p = {r["score"]: r["pvalue"] for r in fdr.p_values(scored).collect()}
    assert p == pytest.approx({0.9: 1 / 3, 0.8: 1 / 3, 0.7: 1 / 3, 0.6: 2 / 3})
    q = {r["cutoff"]: r["qvalue"] for r in fdr.error_table(scored).collect()}
    assert q == pytest.approx({0.9: 0.553846, 0.8: 0.553846, 0.7: 0.553846, 0.6: 0.675}, abs=1e-6)
    assert fdr.cutoffs(fdr.error_table(scored)).first()["cutoff"] == 0.7
    assert rows(fdr.fdr_filter(scored), "score") == [(0.8,), (0.9,)]
    assert fdr.fdr_filter(scored, 1.0).count() == 7
    pep = [r["pep"] for r in fdr.local_fdr(fdr.error_table(scored)).orderBy("pvalue").collect()]
    assert pep == sorted(pep) and all(0 <= x <= 1 for x in pep)


def test_pi0_of_both_methods(spark):
    """A cubic over the grid at its last point, and the grid's value of least estimated error, for p-values one by one."""
    rng = np.random.default_rng(12)
    p = np.round(np.concatenate([rng.random(600), rng.random(400) ** 6]), 3)
    at, n = np.unique(p, return_counts=True)
    df = spark.createDataFrame([("s", float(a), int(k), float(a)) for a, k in zip(at, n, strict=True)], "sample string, score double, nt long, pvalue double")
    grid = np.arange(1, 20) / 20
    share = np.array([(p >= x).mean() / (1 - x) for x in grid])
    over = np.array([(p >= x).sum() for x in grid])
    error = over / (len(p) * (1 - grid)) ** 2 * (1 - over / len(p)) + (share - np.percentile(share, 0.1)) ** 2
    want = {"smoother": np.polyval(np.polyfit(grid, share, 3), grid[-1]), "bootstrap": share[error.argmin()], "scalar": 1.0}
    for method, value in want.items():
        assert fdr.pi0(df, method).first()["pi0"] == pytest.approx(min(1.0, value), abs=1e-9)


def test_pi0_by_logarithms(spark):
    """Shares that fall by a known law: the curve of their logarithms is found, and a share of 0 gives none."""
    grid = [k / 20 for k in range(1, 20)]
    rng = np.random.default_rng(13)
    p = np.round(np.concatenate([rng.random(900), rng.random(600) ** 8]), 4)
    at, n = np.unique(p, return_counts=True)
    df = spark.createDataFrame([("s", float(a), int(k), float(a)) for a, k in zip(at, n, strict=True)] + [("low", 0.1, 5, 0.1)], "sample string, score double, nt long, pvalue double")
    share = np.array([(p >= x).mean() / (1 - x) for x in grid])
    got = {r["sample"]: r["pi0"] for r in fdr.pi0(df, "smoother", smooth_log=True).collect()}
    assert got["low"] is None and got["s"] == pytest.approx(min(1.0, float(np.exp(np.polyval(np.polyfit(grid, np.log(share), 3), grid[-1])))), abs=1e-9)


@pytest.mark.parametrize("transform", ["probit", "logit"])
def test_local_rates_equal_a_direct_kernel_sum(spark, transform):
    """Both transforms, cut off at 1 or not, rising with p or not, against sums over all p-values."""
    from statistics import NormalDist

    rng = np.random.default_rng(21)
    p = np.sort(np.round(np.concatenate([rng.random(500), rng.random(300) ** 5]), 3).clip(0.001, 0.999))
    at, n = np.unique(p, return_counts=True)
    df = spark.createDataFrame([("s", float(1 - a), int(k), float(a), 0.0) for a, k in zip(at, n, strict=True)], "sample string, cutoff double, n long, pvalue double, qvalue double")
    eps = 1e-8
    of = (lambda v: np.array([NormalDist().inv_cdf(min(max(x, eps), 1 - eps)) for x in v])) if transform == "probit" else (lambda v: np.log((v + eps) / (1 - v + eps)))
    x, all_x = of(at), of(p)
    bw = 1.5 * 0.9 * min(all_x.std(ddof=1), np.subtract(*np.percentile(all_x, [75, 25])) / 1.34) * len(p) ** -0.2
    y = np.exp(-0.5 * ((x[:, None] - all_x[None, :]) / bw) ** 2).sum(axis=1) / (len(p) * bw * np.sqrt(2 * np.pi))
    null = np.exp(-x * x / 2) / np.sqrt(2 * np.pi) if transform == "probit" else np.exp(x) / (1 + np.exp(x)) ** 2
    plain = 0.9 * null / y
    for truncate, monotone in ((True, True), (False, False), (True, False)):
        want = np.minimum(plain, 1) if truncate else plain
        want = np.maximum.accumulate(want) if monotone else want
        got = {r["pvalue"]: r["pep"] for r in fdr.local_fdr(df, 0.9, transform=transform, truncate=truncate, monotone=monotone).collect()}
        assert [got[a] for a in at.tolist()] == pytest.approx(want.tolist(), rel=0.01)
    with pytest.raises(ValueError):
        fdr.local_fdr(df, transform="none")


def test_spline_between_grid_points():
    """A cubic is met exactly, a smooth curve closely."""
    at = np.arange(20.0)
    inside = np.linspace(0, 18.99, 200)
    for curve, near in ((lambda t: t**3 - 9 * t**2 + t, 1e-9), (lambda t: np.sin(t / 4), 2e-4)):
        y, m, i = curve(at), fdr._bends(curve(at)), inside.astype(int)
        v, u = inside - i, 1 - (inside - i)
        got = y[i] * u + y[i + 1] * v + (m[i] * (u**3 - u) + m[i + 1] * (v**3 - v)) / 6
        assert np.abs(got - curve(inside)).max() < near * max(1, np.abs(y).max())


def test_no_decoys_gives_no_p_values(scored):
    assert fdr.error_table(scored.where("not is_decoy")).count() == 0


def test_replicates(spark):
    e = spark.createDataFrame([(0, "a", "b", 0.9), (1, "a", "b", 0.7), (0, "a", "c", 0.6)], "replicate int, src string, dst string, weight double")
    for mode, want in (("max", [0.9, 0.6]), ("mean", [0.8, 0.3]), ("product", [0.63, 0.0])):
        assert [r[2] for r in rows(network.combine(e, 2, mode), "src", "dst", "weight")] == pytest.approx(want)
    assert rows(network.replicate_table(e, [0, 1]), "dst", "weight_0", "weight_1")[0] == ("b", 0.9, 0.7)


def test_cross_condition_scope(spark):
    e = spark.createDataFrame([("c1", 1, 2, 0.9), ("c2", 1, 2, 0.6), ("c1", 3, 4, 0.8)], "cond string, src int, dst int, weight double")
    assert rows(network.cross_condition_max(e), "src", "dst", "weight") == [(1, 2, 0.6)]
    assert rows(network.cross_condition_max(e, "all"), "src", "dst", "weight") == [(1, 2, 0.9), (3, 4, 0.8)]


def test_desirability(spark):
    assert spark.range(1).select(network.desirability(F.lit(1.0), F.lit(0.8)).alias("x")).first()["x"] == pytest.approx(0.861774, abs=1e-6)


def brute_row(x):
    n, k, mean = len(x), (x > 0).sum(), x.mean()
    sd = np.sqrt((((x - mean) ** 2).sum() + mean**2 * (n - k)) / (n - 1))
    return x * (n / k) * max(1.0, sd / mean)


def test_information_and_row_scores(spark):
    x = spark.createDataFrame([(0.75,), (0.5,), (0.0,), (1.0,)], "p double")
    assert [r["i"] for r in x.select(specificity.information(F.col("p")).alias("i")).collect()] == [2, 1, 0, None]
    m = spark.createDataFrame([(0, 0, 2.0), (0, 1, 1.0)], "i int, j int, v double")
    assert [r["wd"] for r in specificity.wd_scores(m, 3).orderBy("j").collect()] == pytest.approx([3.674235, 1.837117], abs=1e-6)
    assert [r["wd"] for r in specificity.wd_scores(m, 3).orderBy("j").collect()] == pytest.approx(brute_row(np.array([2.0, 1.0, 0.0]))[:2])


def test_null_scores_do_not_depend_on_tasks(spark):
    assert specificity.null_cutoff(spark, 20, 50).first()[0] == specificity.null_cutoff(spark, 20, 50).repartition(3).first()[0] > 0


def test_mcc(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.1), (0, 0.6)], "y int, p double")
    assert df.agg(features.mcc(F.col("y"), F.col("p")).alias("x")).first()["x"] == 0.0


def test_markov_clusters(spark):
    e = [(i, j, 1.0) for g in ((0, 1, 2), (3, 4, 5)) for i in g for j in g if i != j]
    m = spark.createDataFrame(e, "i int, j int, v double")
    found = cluster.clusters(cluster.run_mcl(m, iterations=20))
    assert rows(found, "members") == [([0, 1, 2],), ([3, 4, 5],)]
    assert cluster.modularity(m, found).first()["q"] is not None
    assert cluster.cluster_table(found).count() == 2
    sums = [r["s"] for r in cluster.normalize(m).groupBy("j").agg(F.sum("v").alias("s")).collect()]
    assert sums == pytest.approx([1.0] * 6)


def test_validation(spark):
    sheet = spark.createDataFrame([("f", "c", 1, "x", 1, 64), ("g", "c", 1, "x", 1, 64)], tables.SHEET)
    with pytest.raises(validate.DuplicateIdentifierError):
        validate.check(sheet, "ids")
    with pytest.raises(validate.EmptyColumnError):
        validate.check(spark.createDataFrame([("f", None, 1, "x", 1, 64)], tables.SHEET), "ids")
    with pytest.raises(validate.MissingColumnError):
        validate.check(sheet.drop("fr"), "ids")
