"""The whole run over small matrices, and the readers and writers around it."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from elutra.operators import network, pairs, specificity
from elutra.plans import pipeline
from elutra.plans.config import RunConfig
from elutra.plans.pipeline import Run
from elutra.sources import sinks, tables, validate


@pytest.fixture(scope="module")
def sheet(tmp_path_factory):
    """Two replicates of twelve proteins in three groups that elute together."""
    folder, rng = tmp_path_factory.mktemp("run"), np.random.default_rng(7)
    at = np.arange(30)
    lines = ["\t".join(["Sample", "cond", "group", "short_id", "repl", "fr"])]
    for repl in (1, 2):
        rows = ["\t".join(["GN", *map(str, range(30))])]
        for k in range(12):
            centre = (6, 14, 23)[k % 3]
            v = np.round(100 * np.exp(-0.5 * ((at - centre) / 2) ** 2) + rng.random(30), 3)
            rows.append("\t".join([f"P{k}", *map(str, v)]))
        (folder / f"m{repl}.txt").write_text("\n".join(rows) + "\n")
        lines.append("\t".join([str(folder / f"m{repl}.txt"), "a", "1", "x", str(repl), "30"]))
    (folder / "ids.txt").write_text("\n".join(lines) + "\n")
    return folder / "ids.txt"


def test_run(spark, sheet):
    out = str(sheet.parent / "out")
    config = RunConfig(sheet=str(sheet), out=out, fdr=1.0, scorer="mean", null_iterations=20, clusters=False)
    found = Run(spark, config).run()
    edges = {(r["src"], r["dst"]) for r in found["network"].where("src not like '%DECOY%'").collect()}
    together = {(f"P{i}", f"P{j}") for i in range(12) for j in range(12) if i % 3 == j % 3 and f"P{i}" < f"P{j}"}
    assert together <= edges
    listed = spark.read.option("sep", "\t").option("header", True).csv(f"{out}/adj_list/cond=a")
    assert listed.columns == ["prot_a", "prot_b", "comb_prob", "confidence"]
    assert spark.read.option("sep", "\t").option("header", True).csv(f"{out}/d_scores").columns == ["ProtA", "ProtB", "WD"]
    again = Run(spark, RunConfig(**{**config.__dict__, "resume": True})).run()
    assert again["network"].count() == found["network"].count()


@pytest.fixture(scope="module")
def three(tmp_path_factory):
    """Three conditions, of two, one and two replicates; matrices of different length with keys in any column."""
    folder, rng = tmp_path_factory.mktemp("three conditions"), np.random.default_rng(11)
    lines, files = ["\t".join(["Sample", "cond", "group", "short_id", "repl", "fr"])], []
    for cond, repl, n in (("a", 1, 30), ("a", 2, 26), ("b", 1, 30), ("c", 1, 33), ("c", 2, 30)):
        at, path = np.arange(n), folder / f"{cond} {repl}.txt"
        rows = []
        for k in range(9 + repl):
            centre = (6, 14, 21)[(k + (cond == "c") * (k // 6)) % 3]
            v = np.round(100 * np.exp(-0.5 * ((at - centre) / 2) ** 2) + rng.random(n), 3)
            rows.append([f"P{k}", *map(str, v)])
        place = 3 if cond == "b" else 0
        cells = [["GN", *map(str, range(n))], *rows]
        path.write_text("\n".join("\t".join([*r[1 : 1 + place], r[0], *r[1 + place :]]) for r in cells) + "\n")
        lines.append("\t".join([str(path), cond, "1", f"{cond}x", str(repl), str(n)]))
        files.append((f"{cond}_{repl}_x", str(path)))
    (folder / "ids.txt").write_text("\n".join(lines) + "\n")
    return folder, files


def told(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_matrices_in_one_scan(spark, three):
    _, files = three
    together = tables.read_matrices(spark, files)
    for sample, path in files:
        assert told(together.where(F.col("sample") == sample), "key", "vals") == told(tables.read_matrix(spark, path), "key", "vals")
    legacy = tables.read_matrices(spark, files[:2], legacy=True)
    for sample, path in files[:2]:
        assert told(legacy.where(F.col("sample") == sample), "key", "vals") == told(tables.read_matrix(spark, path, legacy=True), "key", "vals")


def test_all_samples_in_one_plan_equal_each_alone(spark, three):
    """Pairs, decoys, ids and edges of five samples in one job are those of five jobs of one sample."""
    _, files = three
    config = RunConfig(fdr=1.0, scorer="mean", correlation=0.3)
    profiles = pipeline.normalized(tables.read_matrices(spark, files), config)
    prior = spark.createDataFrame([("P0", "P1"), ("P0", "P10"), ("P3", "P3")], "a string, b string")
    table = pipeline.keep(pipeline.candidate_pairs(profiles, prior, config))
    edges = told(pipeline.edges_of(pipeline.controlled(pipeline.scored_pairs(table, profiles, config))), "sample", "src", "dst", "weight")
    apart_pairs, apart_edges = [], []
    for sample, path in files:
        own = pipeline.normalized(tables.read_matrix(spark, path), config)
        positives, known = pairs.correlated_pairs(own, 0.3), pairs.prior_pairs(prior, own)
        k = positives.count() + known.where("a <> b").count()
        one = pairs.pair_table(positives, pairs.decoy_pairs(own, k, 0.3, config.seed), known).withColumn("sample", F.lit(sample))
        one = pipeline.keep(one)
        apart_pairs += told(one, "sample", "id", "a", "b", "is_decoy")
        apart_edges += told(pipeline.edges_of(pipeline.controlled(pipeline.scored_pairs(one, own.withColumn("sample", F.lit(sample)), config))), "sample", "src", "dst", "weight")
    assert told(table, "sample", "id", "a", "b", "is_decoy") == sorted(apart_pairs)
    assert edges and [e[:3] for e in edges] == [e[:3] for e in sorted(apart_edges)]
    assert [e[3] for e in edges] == pytest.approx([e[3] for e in sorted(apart_edges)])


def test_run_of_three_conditions(spark, three):
    folder, _ = three
    out = str(folder / "out")
    found = Run(spark, RunConfig(sheet=str(folder / "ids.txt"), out=out, fdr=1.0, scorer="mean", null_iterations=20, merge_scope="all")).run()
    edges, samples = found["edges"], {"a": 2, "b": 1, "c": 2}
    assert {r["cond"] for r in edges.select("cond").distinct().collect()} == set(samples)
    for cond in samples:
        own = network.combine(edges.where(F.col("cond") == cond), samples[cond])
        assert told(found["conditions"].where(F.col("cond") == cond), "src", "dst", "weight") == told(own, "src", "dst", "weight")
        kept, ids = network.prune(own, 0.5)
        m = network.symmetrize(kept).select(F.col("src").alias("i"), F.col("dst").alias("j"), specificity.information(F.col("weight")).alias("v"))
        want = told(specificity.wd_scores(m, ids.count()), "i", "j", "wd")
        got = told(found["specificity_by_condition"].where(F.col("cond") == cond), "i", "j", "wd")
        assert [x[:2] for x in got] == [x[:2] for x in want] and [x[2] for x in got] == pytest.approx([x[2] for x in want])
    listed = spark.read.option("sep", "\t").option("header", True).csv(f"{out}/adj_list")
    assert {r["cond"] for r in listed.select("cond").distinct().collect()} == set(samples)


def test_matrix_readers(spark, tmp_path):
    path = tmp_path / "m.txt"
    path.write_text("GN\ta\tb\tc\nX\t1\t2\t3\nY\t4\t5\t6\nX\t7\t8\t9\n")
    strict = tables.read_matrix(spark, str(path))
    assert sorted((r["key"], r["vals"]) for r in strict.collect()) == [("X", [1, 2, 3]), ("X", [7, 8, 9]), ("Y", [4, 5, 6])]
    legacy = tables.read_matrix(spark, str(path), legacy=True)
    assert sorted((r["key"], r["vals"]) for r in legacy.collect()) == [("X", [7, 8, 9]), ("Y", [4, 5, 6])]


def test_legacy_file_without_heading(spark, tmp_path):
    (tmp_path / "m.txt").write_text("X\t1\t2\n")
    with pytest.raises(validate.MissingColumnError):
        tables.read_matrix(spark, str(tmp_path / "m.txt"), legacy=True)


def test_small_readers(spark):
    df = spark.createDataFrame([("c", "a;b;c"), ("d", "a;b")], ["ComplexName", "subunits(Gene name)"])
    assert sorted(tuple(r) for r in tables.complexes_to_pairs(df).collect()) == [("a", "b"), ("a", "c"), ("b", "c")]
    c = spark.createDataFrame([("g", "r", "u", 0, 2, 3)], "Gene string, RefSeq string, UniProt string, x int, y int, z int")
    assert tables.contaminant_frequency(c).first()["freq"] == pytest.approx(2 / 3)
    m = spark.createDataFrame([("1",), ("nan",), ("",), ("x",)], "v string")
    assert [r["v"] for r in m.select(tables.without_missing(F.col("v")).alias("v")).collect()] == [1.0, None, None, None]
    p = spark.createDataFrame([("i", "m", 3, 1), ("i", "n", 4, 0)], "ID string, MB string, PKS int, SEL int")
    assert tables.peak_lists(p).first()["peaks"] == {"m": "3\t1", "n": "4\t0"}


def test_wide_output(spark):
    df = spark.createDataFrame([("p", [0.5, 1.0])], "key string, vals array<double>")
    assert tuple(sinks.wide_matrix(df, 2).first()) == ("p", 0.5, 1.0)
    e = spark.createDataFrame([(0, 1, 0.5)], "src int, dst int, weight double")
    assert [tuple(r) for r in sinks.dense_adjacency(e, [0, 1]).collect()] == [(0, 0.0, 0.5), (1, 0.5, 0.0)]
