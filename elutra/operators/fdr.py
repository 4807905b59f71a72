"""Target-decoy statistics. Rows are (sample, score, is_decoy, ...); scores lie in 0..1; every step is done for each sample."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from elutra.operators.running import running
from elutra.plans.stages import keep

BY = ["sample"]


def counts(scored: DataFrame) -> DataFrame:
    """(sample, score, nt, nd): targets and decoys at each distinct score."""
    target = (~F.col("is_decoy")).cast("long")
    return scored.where("score is not null and not isnan(score)").groupBy("sample", "score").agg(F.sum(target).alias("nt"), F.sum(1 - target).alias("nd"))


def p_values(scored: DataFrame) -> DataFrame:
    """(sample, score, nt, pvalue) of each distinct target score: the share of decoys above it, at least one over their number.

    Samples without targets or without decoys have no p-values.
    """
    per = counts(scored)
    totals = per.groupBy("sample").agg(F.sum("nd").alias("m0")).where("m0 > 0")
    above = running(per, BY, "score", "nd", "above", ascending=False, strict=True)
    at = above.where("nt > 0").join(totals, "sample")
    return at.select("sample", "score", "nt", F.greatest(F.col("above") / F.col("m0"), 1 / F.col("m0")).alias("pvalue"))


def pi0_counts(p: DataFrame, lambdas: list[float]) -> DataFrame:
    """(sample, lambda, pi0): the share of p-values of at least lambda, over 1 - lambda."""
    grid = F.explode(F.array(*[F.lit(float(x)) for x in lambdas]))
    at = p.withColumn("lambda", grid).groupBy("sample", "lambda").agg(F.sum("nt").alias("m"), F.sum(F.when(F.col("pvalue") >= F.col("lambda"), F.col("nt")).otherwise(0)).alias("n"))
    return at.select("sample", "lambda", (F.col("n") / F.col("m") / (1 - F.col("lambda"))).alias("pi0"))


def pi0(p: DataFrame, method: str = "scalar", lambdas: list[float] | None = None, smooth_log: bool = False, degree: int = 3) -> DataFrame:
    """(sample, pi0), at most 1: at one lambda (0), by a smooth curve over a grid of them, or by the least mean squared error.

    The curve is the smoothing spline whose squared residuals may reach the number of points: one polynomial of ``degree`` does that for
    shares of p-values. With ``smooth_log`` it runs through their logarithms; samples with a share of 0 have no value then.
    """
    lambdas = lambdas or ([0.0] if method == "scalar" else [k / 20 for k in range(1, 20)])
    at = pi0_counts(p, lambdas)
    if method == "scalar":
        return at.select("sample", F.least("pi0", F.lit(1.0)).alias("pi0"))
    sizes = p.groupBy("sample").agg(F.sum("nt").alias("m"))

    def one(frame: pd.DataFrame) -> pd.DataFrame:  # a row for each lambda
        frame = frame.sort_values("lambda")
        x, y, m = frame["lambda"].to_numpy(), frame["pi0"].to_numpy(), float(frame["m"].iloc[0])
        if method == "smoother":
            if smooth_log and (y <= 0).any():
                return pd.DataFrame({"sample": frame["sample"].iloc[:1], "pi0": [None]}, dtype=object)
            curve = np.polyval(np.polyfit(x, np.log(y) if smooth_log else y, degree), x[-1])
            got = float(np.exp(curve) if smooth_log else curve)
        else:
            n = y * m * (1 - x)
            error = n / (m * (1 - x)) ** 2 * (1 - n / m) + (y - np.percentile(y, 0.1)) ** 2
            got = float(y[np.argmin(error)])
        return pd.DataFrame({"sample": frame["sample"].iloc[:1], "pi0": [min(1.0, got)]})

    return at.join(sizes, "sample").groupBy("sample").applyInPandas(one, f"sample {dict(p.dtypes)['sample']}, pi0 double")


def q_values(p: DataFrame, pi0s: DataFrame | None = None, pfdr: bool = True) -> DataFrame:
    """(sample, pvalue, n, qvalue) of each distinct p-value of ``p``; pi0 is 1 unless ``pi0s`` (sample, pi0) says otherwise.

    The largest p-value is capped at 1 by itself; if only one row has it, it does not bound the others.
    """
    per = p.groupBy("sample", "pvalue").agg(F.sum("nt").alias("n"))
    totals = per.groupBy("sample").agg(F.sum("n").alias("m"), F.max("pvalue").alias("_last"))
    at = running(per, BY, "pvalue", "n", "v").join(totals, "sample")
    at = at.withColumn("_pi0", F.lit(1.0)) if pi0s is None else at.join(pi0s.withColumnRenamed("pi0", "_pi0"), "sample")
    below = F.col("v") * (1 - F.pow(1 - F.col("pvalue"), F.col("m"))) if pfdr else F.col("v")
    at = at.withColumn("_raw", F.try_divide(F.col("_pi0") * F.col("m") * F.col("pvalue"), below))
    single = (F.col("pvalue") == F.col("_last")) & (F.col("n") == 1)
    at = at.withColumn("_bound", F.when(~single, F.col("_raw")))
    at = running(at, BY, "pvalue", "_bound", "_least", how="min", ascending=False)
    return at.select("sample", "pvalue", "n", F.when(single, F.least("_raw", F.lit(1.0))).otherwise(F.col("_least")).alias("qvalue"))


def error_table(scored: DataFrame, pi0_method: str = "scalar", pfdr: bool = True) -> DataFrame:
    """(sample, cutoff, n, pvalue, qvalue): a row for each distinct target score, with the number of targets that have it."""
    p = keep(p_values(scored))  # q-values are made from it, and joined with it
    q = q_values(p, None if pi0_method == "scalar" else pi0(p, pi0_method), pfdr)
    return p.join(q.drop("n"), ["sample", "pvalue"]).select("sample", F.col("score").alias("cutoff"), F.col("nt").alias("n"), "pvalue", "qvalue")


def cutoffs(errors: DataFrame, fdr: float = 0.1) -> DataFrame:
    """(sample, cutoff): the score whose q-value is nearest to ``fdr``, the lowest of equally near ones."""
    off = F.round(F.abs(F.col("qvalue") - fdr), 9)
    return errors.groupBy("sample").agg(F.min_by("cutoff", F.struct(off, "cutoff")).alias("cutoff"))


def fdr_filter(scored: DataFrame, fdr: float = 0.1, floor: float = 0.5) -> DataFrame:
    """Targets over their sample's cutoff. The floor comes first, so it counts for the statistics.

    With ``fdr`` of 1 or more only the floor holds, and decoys stay.
    """
    scored = scored.where(F.col("score") >= floor)
    if fdr >= 1:
        return scored
    scored = keep(scored)
    return scored.join(cutoffs(error_table(scored), fdr), "sample").where((F.col("score") > F.col("cutoff")) & ~F.col("is_decoy")).drop("cutoff")


def bandwidth(values: DataFrame, x: str = "x") -> DataFrame:
    """(sample, bw): 0.9 times the least of standard deviation and scaled quartile distance, by the fifth root of the number."""
    got = values.groupBy("sample").agg(F.stddev_samp(x).alias("sd"), F.percentile(x, F.lit(0.75)).alias("q3"), F.percentile(x, F.lit(0.25)).alias("q1"), F.count(x).alias("n"), F.first(x).alias("any"))
    spread = F.least("sd", (F.col("q3") - F.col("q1")) / 1.34)
    spread = F.coalesce(F.nullif(spread, F.lit(0.0)), F.nullif("sd", F.lit(0.0)), F.nullif(F.abs("any"), F.lit(0.0)), F.lit(1.0))
    return got.select("sample", (0.9 * spread * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("bw"))


def _bends(y: np.ndarray) -> np.ndarray:
    """Second differences of the cubic spline through equally spaced values, in units of the step; its third derivative doesn't jump at the second and the last but one."""
    n = len(y)
    system, right = np.zeros((n, n)), np.zeros(n)
    inner = np.arange(1, n - 1)
    system[inner, inner - 1], system[inner, inner], system[inner, inner + 1] = 1, 4, 1
    right[inner] = 6 * (y[:-2] - 2 * y[1:-1] + y[2:])
    system[0, :3] = system[-1, -3:] = 1, -2, 1
    return np.linalg.solve(system, right)


def local_fdr(errors: DataFrame, pi0_value: float = 1.0, adjust: float = 1.5, eps: float = 1e-8, grid: int = 512, transform: str = "probit", truncate: bool = True, monotone: bool = True) -> DataFrame:
    """``errors`` with pep: the local false discovery rate by a Gaussian density of transformed p-values.

    ``transform`` is "probit", against the normal density, or "logit", against the derivative of its inverse. ``truncate`` keeps rates at 1
    at most, ``monotone`` never lets them fall with p. The density is summed on a grid, between whose points a cubic spline runs, from
    a histogram of at most ``4 * grid`` bins for each sample, so that no task holds a sample's rows.
    """
    from statistics import NormalDist

    normal = NormalDist()

    @F.pandas_udf("double")
    def probit(p: pd.Series) -> pd.Series:
        return p.clip(eps, 1 - eps).map(normal.inv_cdf)

    if transform not in ("probit", "logit"):
        raise ValueError(f"no transform is called {transform}")
    x = F.col("_x")
    at = errors.withColumn("_x", probit("pvalue") if transform == "probit" else F.ln((F.col("pvalue") + eps) / (1 - F.col("pvalue") + eps)))
    wide = at.groupBy("sample").agg(F.min("_x").alias("lo"), F.max("_x").alias("hi"), (F.sum("n") / 1.0).alias("m"), F.sum(F.col("_x") * F.col("n")).alias("s1"), F.sum(F.col("_x") ** 2 * F.col("n")).alias("s2"))
    bins = 4 * grid
    binned = at.join(wide.select("sample", "lo", "hi"), "sample")
    bin_at = F.floor(F.coalesce(F.try_divide(F.col("_x") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)) * (bins - 1) + 0.5)
    heights = binned.groupBy("sample", bin_at.alias("bin")).agg(F.sum("n").alias("n")).join(wide, "sample")
    kind = dict(errors.dtypes)["sample"]

    def density(frame: pd.DataFrame) -> pd.DataFrame:  # at most ``bins`` rows
        lo, hi, m, s1, s2 = (float(frame[c].iloc[0]) for c in ("lo", "hi", "m", "s1", "s2"))
        sd = max(0.0, (s2 - s1 * s1 / m) / max(m - 1, 1)) ** 0.5 or 1.0
        x, w = lo + (hi - lo) * frame["bin"].to_numpy(float) / (bins - 1), frame["n"].to_numpy(float)
        order = np.argsort(x)
        share = np.cumsum(w[order]) / m
        quartiles = np.interp([0.25, 0.75], share, x[order])
        bw = adjust * 0.9 * (min(sd, (quartiles[1] - quartiles[0]) / 1.34) or sd) * m**-0.2
        at = np.linspace(lo - 3 * bw, hi + 3 * bw, grid)
        y = (np.exp(-0.5 * ((at[:, None] - x[None, :]) / bw) ** 2) @ w) / (m * bw * np.sqrt(2 * np.pi))
        return pd.DataFrame({"sample": [frame["sample"].iloc[0]], "first": [at[0]], "step": [at[1] - at[0]], "density": [y.tolist()], "bends": [_bends(y).tolist()]})

    curves = heights.groupBy("sample").applyInPandas(density, f"sample {kind}, first double, step double, density array<double>, bends array<double>")
    place = (x - F.col("first")) / F.col("step")
    i = F.floor(place).cast("int")
    v, u = place - i, 1 - (place - i)
    line = F.get("density", i) * u + F.get("density", i + 1) * v
    y = line + (F.get("bends", i) * (u * u * u - u) + F.get("bends", i + 1) * (v * v * v - v)) / 6
    null = F.exp(-x * x / 2) / F.lit(float(np.sqrt(2 * np.pi))) if transform == "probit" else F.exp(-F.abs(x)) / F.pow(1 + F.exp(-F.abs(x)), F.lit(2.0))
    rate = pi0_value * F.try_divide(null, y)
    raw = at.join(curves, "sample").withColumn("_raw", F.least(F.lit(1.0), rate) if truncate else rate)
    if not monotone:
        return raw.withColumn("pep", F.col("_raw")).select(*errors.columns, "pep")
    per = raw.groupBy("sample", "pvalue").agg((-F.max("_raw")).alias("_low"))
    risen = running(per, BY, "pvalue", "_low", "_least", how="min").select("sample", "pvalue", (-F.col("_least")).alias("pep"))
    return errors.join(risen, ["sample", "pvalue"])


def fdr_curve(scored: DataFrame) -> DataFrame:
    """(sample, score, target, decoy, fdr) at each distinct score: shares at or above it, and their ratio, at most 1."""
    per = counts(scored)
    totals = per.groupBy("sample").agg(F.sum("nt").alias("mt"), F.sum("nd").alias("md"))
    at = running(running(per, BY, "score", "nt", "t", ascending=False), BY, "score", "nd", "d", ascending=False).join(totals, "sample")
    target, decoy = F.try_divide("t", "mt"), F.try_divide("d", "md")
    return at.select("sample", "score", target.alias("target"), decoy.alias("decoy"), F.coalesce(F.least(F.try_divide(decoy, target), F.lit(1.0)), F.lit(1.0)).alias("fdr"))


def nearest(errors: DataFrame, grid: list[float], column: str = "cutoff") -> DataFrame:
    """(sample, at, cutoff, pvalue, qvalue): the row nearest to each value of ``grid``, the lowest of equally near ones."""
    wanted = errors.withColumn("at", F.explode(F.array(*[F.lit(float(g)) for g in grid])))
    off = F.struct(F.round(F.abs(F.col(column) - F.col("at")), 9), "cutoff")
    return wanted.groupBy("sample", "at").agg(F.min_by(F.struct("cutoff", "pvalue", "qvalue"), off).alias("x")).select("sample", "at", "x.*")


def histogram(scored: DataFrame, bins: int = 20) -> DataFrame:
    """(isdecoy, bin, n) of scores in 0..1."""
    at: Column = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    return scored.groupBy(F.when(F.col("is_decoy"), "DECOY").otherwise("TARGET").alias("isdecoy"), at.alias("bin")).agg(F.count("*").alias("n"))
