"""The run from matrices to networks: every stage is a Parquet table, partitioned by sample or condition."""

from __future__ import annotations

import argparse
import dataclasses
import hashlib
import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from elutra.functions import names, signal
from elutra.functions import profiles as p
from elutra.operators import cluster, fdr, features, network, pairs, specificity
from elutra.plans.config import RunConfig
from elutra.plans.stages import keep
from elutra.sources import sinks, tables, validate


#: Stages before the error control have a row's sample beside it.
SAMPLE = ("sample",)


def normalized(matrix: DataFrame, config: RunConfig) -> DataFrame:
    """(sample, key, vals): profiles with enough support, gaps filled, resampled and scaled. Without a sample column, all is one."""
    by = [c for c in SAMPLE if c in matrix.columns]
    kept = matrix.where(p.support(F.col("vals")) >= config.min_support)
    out = kept.select(*by, "key", p.normalize(F.col("vals"), config.points, sigma=config.smooth).alias("vals"))
    if not config.split_peaks:
        return out
    part = signal.ready(out).select(*by, "key", F.explode(signal.split_peaks(F.col("vals"))).alias("x"))
    name = F.when(F.col("x.part").isNull(), F.col("key")).otherwise(F.concat("key", F.lit("_p_"), F.col("x.part").cast("string")))
    return part.select(*by, name.alias("key"), F.col("x.vals").alias("vals"))


def candidate_pairs(profiles: DataFrame, prior: DataFrame | None, config: RunConfig) -> DataFrame:
    """(sample, id, a, b, mb, is_decoy): correlated and prior pairs of each sample's profiles, and as many decoys."""
    positives = keep(pairs.correlated_pairs(profiles, config.correlation, by="sample").select("sample", "a", "b"))
    prior = None if prior is None else keep(pairs.prior_pairs(prior, profiles, by="sample"))
    told = positives if prior is None else positives.unionByName(prior.where("a <> b"))
    decoys = pairs.decoys_by(profiles, pairs.sizes_by(told, "sample", "k"), "sample", config.correlation, config.seed)
    return pairs.pair_table(positives, decoys, prior, by="sample")


def scored_pairs(table: DataFrame, profiles: DataFrame, config: RunConfig) -> DataFrame:
    """(sample, prot_a, prot_b, isdecoy, prob): one scorer for all samples."""
    found = features.pair_features(table, features.with_peaks(profiles), config.window, SAMPLE)
    rows = features.assemble(found, by=SAMPLE)
    return features.score(rows, scorer_of(rows, config), SAMPLE)


def scorer_of(rows: DataFrame, config: RunConfig) -> features.Scorer:
    """Fit on the rows, read from a stored network, or the plain mean of correlations."""
    if config.scorer == "stored":
        if config.model is None:
            raise ValueError("a stored scorer needs the path of its model")
        return features.Layers.load(rows.sparkSession, config.model)
    return features.Logistic.fit(rows) if config.scorer == "logistic" else features.MeanCorrelation(config.points)


def scored_networks(profiles: DataFrame, prior: DataFrame | None, config: RunConfig) -> DataFrame:
    """(sample, src, dst, weight): the pairs of all samples that pass the error control. One plan for any number of samples."""
    scored = scored_pairs(candidate_pairs(profiles, prior, config), profiles, config)
    return edges_of(fdr.fdr_filter(controlled(scored), config.fdr, config.probability_floor))


def controlled(scored: DataFrame) -> DataFrame:
    return scored.select("sample", "prot_a", "prot_b", F.col("prob").alias("score"), (F.col("isdecoy") == "DECOY").alias("is_decoy"))


def edges_of(kept: DataFrame) -> DataFrame:
    own = kept.where("prot_a <> prot_b").select("sample", F.least("prot_a", "prot_b").alias("src"), F.greatest("prot_a", "prot_b").alias("dst"), F.col("score").alias("weight"))
    return own.groupBy("sample", "src", "dst").agg(F.max("weight").alias("weight"))


def by_condition(edges: DataFrame, samples: DataFrame, mode: str = "max") -> DataFrame:
    """(cond, src, dst, weight): replicates of each condition merged. ``samples``: (sample, cond, replicate)."""
    sizes = samples.groupBy("cond").agg(F.count_distinct("replicate").alias("_n"))
    told = edges.join(F.broadcast(samples.join(sizes, "cond")), "sample")  # a row for each input file
    one = told.groupBy("cond", "_n", "replicate", "src", "dst").agg(F.max("weight").alias("weight"))
    return network.combine(one, "_n", mode, ("cond",))


def specificity_by_condition(merged: DataFrame, config: RunConfig) -> DataFrame:
    """(cond, i, j, v, wd): row scores in the network of each condition, before any cutoff."""
    kept = merged.where(F.col("weight") >= config.probability_floor)
    sizes = kept.select("cond", F.explode(F.array("src", "dst")).alias("id")).distinct().groupBy("cond").agg(F.count("*").alias("_n"))
    both = network.symmetrize(kept, ("cond",)).select("cond", F.col("src").alias("i"), F.col("dst").alias("j"), specificity.information(F.col("weight"), config.probability_one).alias("v"))
    return specificity.wd_scores(both.join(sizes, "cond"), "_n", ("cond",))


class Run:
    """Stages by name. With ``resume``, a stage whose table is there for the same settings is read, not made."""

    def __init__(self, spark: SparkSession, config: RunConfig):
        self.spark, self.config = spark, config
        self.mark = hashlib.sha256(json.dumps(dataclasses.asdict(dataclasses.replace(config, resume=False)), sort_keys=True).encode()).hexdigest()[:12]

    def stage(self, name: str, make: Callable[[], DataFrame], by: str | None = None) -> DataFrame:
        """The stage's table, partitioned by a column if one is given. Its schema lies beside it, so that empty ones and partitions of any name are read as they were."""
        path = f"{self.config.out}/tmp/{self.mark}/{name}"
        done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not (self.config.resume and done.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(done)):
            df = make()
            self.spark.createDataFrame([(df.schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}-schema")
            writer = df.write.mode("overwrite")
            (writer.partitionBy(by).option("partitionOverwriteMode", "dynamic") if by else writer).parquet(path)
        schema = T.StructType.fromJson(json.loads(self.spark.read.text(f"{path}-schema").first()["value"]))
        return self.spark.read.schema(schema).parquet(path)

    def run(self) -> dict[str, DataFrame]:
        """All samples of the sheet go through every stage together; what is told for each condition is partitioned by it."""
        c, spark = self.config, self.spark
        sheet = tables.read_sheet(spark, c.sheet)
        validate.check(sheet, "ids")
        files = [(f"{r['cond']}_{r['repl']}_{r['short_id']}", r["Sample"], r["cond"], r["repl"]) for r in sheet.orderBy("cond", "repl").collect()]  # a row for each input file
        samples = spark.createDataFrame([(f[0], f[2], f[3]) for f in files], "sample string, cond string, replicate int")
        profiles = self.stage("profiles", lambda: normalized(tables.read_matrices(spark, [f[:2] for f in files], legacy=c.legacy_tabs), c), "sample")
        prior = tables.read_prior(spark, c.prior) if c.prior else None
        candidates = self.stage("pairs", lambda: candidate_pairs(profiles, prior, c), "sample")
        scored = self.stage("scored", lambda: scored_pairs(candidates, profiles, c), "sample")
        rows = controlled(scored)
        self.stage("errors", lambda: fdr.local_fdr(fdr.error_table(rows.where(F.col("score") >= c.probability_floor))), "sample")
        kept = self.stage("kept", lambda: fdr.fdr_filter(rows, c.fdr, c.probability_floor), "sample")
        edges = self.stage("edges", lambda: edges_of(kept), "sample")
        merged = self.stage("combined", lambda: by_condition(edges, samples, c.combine_mode), "cond")
        told = edges.join(F.broadcast(samples), "sample")
        over = merged.where(F.col("weight") >= c.probability_floor)
        sinks.write_tsv(sinks.probability_table(network.replicate_table(told, sorted({f[3] for f in files}), ("cond",))), f"{c.out}/probtot", by="cond")
        sinks.write_tsv(network.edge_list(merged, c.probability_floor, ("cond",)), f"{c.out}/adj_list", by="cond")
        sinks.write_tsv(network.neighbours(over, ("cond",)).orderBy("cond", "protein"), f"{c.out}/prot_centr", by="cond")
        own = self.stage("specificity_by_condition", lambda: specificity_by_condition(merged, c), "cond")
        final, ids = network.prune(self.stage("network", lambda: network.cross_condition_max(merged, c.merge_scope)), c.probability_floor)
        if c.contaminants:
            final = network.drop_contaminants(final, tables.contaminant_frequency(tables.tsv(spark, c.contaminants)), c.contaminant_threshold)
            ids = network.vertices(final)
        n = ids.count()
        matrix = network.symmetrize(final).select(F.col("src").alias("i"), F.col("dst").alias("j"), specificity.information(F.col("weight"), c.probability_one).alias("v"))
        scores = self.stage("specificity", lambda: specificity.apply_cutoff(specificity.wd_scores(matrix, n), specificity.null_cutoff(spark, max(n, 2), c.null_iterations, c.null_quantile, c.seed)))
        listed = specificity.upper_triangle(scores, ids if c.full_triangle else None)
        sinks.write_tsv(listed.toDF("ProtA", "ProtB", "WD"), f"{c.out}/d_scores")
        found = {"edges": told, "conditions": merged, "network": final, "specificity": listed, "specificity_by_condition": own}
        if c.clusters:
            m = network.symmetrize(final).select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("weight").alias("v"))
            best, _ = cluster.best_inflation(m, np.linspace(*c.inflations).tolist())
            found["clusters"] = cluster.cluster_table(cluster.clusters(cluster.run_mcl_grid(m, [best], expansion=3)))
            sinks.write_tsv(found["clusters"], f"{c.out}/communities")
        sinks.write_config(spark, c, f"{c.out}/config")
        return found


def main(argv: list[str] | None = None) -> None:
    """The command line: ``python -m elutra.plans.pipeline -sid sheet.tsv -out folder``."""
    parser = argparse.ArgumentParser(description="Interaction networks from co-fractionation profiles")
    parser.add_argument("-db", default="False", help="prior network, two columns; False for none")
    parser.add_argument("-fdr", type=float, default=0.1)
    parser.add_argument("-sid", default="sample_ids.txt", help="sample sheet")
    parser.add_argument("-out", default="output")
    parser.add_argument("-crapome", default=None, help="contaminant table")
    parser.add_argument("-thres", type=float, default=0.5, help="contaminant frequency from which a protein goes")
    parser.add_argument("-skip", default="False", help="anything but False resumes from the tables of an earlier run")
    parser.add_argument("-merge", default="last", choices=("last", "all"))
    parser.add_argument("-clusters", action="store_true")
    parser.add_argument("-model", default=None, help="a stored network that scores pairs; without one a regression is fitted")
    a = parser.parse_args(argv)
    config = RunConfig(sheet=a.sid, out=a.out, prior=None if a.db == "False" else a.db, contaminants=a.crapome, fdr=a.fdr, contaminant_threshold=a.thres, resume=a.skip != "False", merge_scope=a.merge, clusters=a.clusters, scorer="stored" if a.model else "logistic", model=a.model)
    Run(SparkSession.builder.appName("elutra").getOrCreate(), config).run()


__all__ = ["Run", "RunConfig", "candidate_pairs", "main", "names", "normalized", "scored_pairs"]

if __name__ == "__main__":
    main()
