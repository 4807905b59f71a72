"""The registered queries: each applies an operator to whole test tables. SQL is in ``elutra.oracles``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from elutra.functions import names, signal
from elutra.functions import profiles as p
from elutra.operators import block_features, cluster, factors, fdr, features, network, pairs, specificity
from elutra.operators.components import components
from elutra.plans import pipeline
from elutra.plans.config import RunConfig
from elutra.plans.stages import Rounds, keep, shared_folder
from elutra.sources import sinks, tables, validate

MONTHS = 83  # months from January 1995 on that the line items span
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c) -> F.Column:
    """Rounded for comparison; the sum with zero takes the sign from -0.0."""
    return F.round(c, 6) + F.lit(0.0)


# What the test tables stand for


def profiles(spark: SparkSession, sf: str) -> DataFrame:
    """(key, vals): for each supplier the quantities returned by month."""
    items = table(spark, sf, "lineitem").where("l_returnflag = 'R' and l_linestatus = 'F'")
    month = (F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1
    sums = items.groupBy("l_suppkey", month.alias("m")).agg(F.sum("l_quantity").alias("q"))
    # At most one entry for each month.
    maps = sums.groupBy("l_suppkey").agg(F.map_from_entries(F.collect_list(F.struct("m", "q"))).alias("x"))
    joined = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key")).join(maps, F.col("key") == F.col("l_suppkey"), "left")
    vals = F.transform(F.sequence(F.lit(0), F.lit(MONTHS - 1)), lambda i: F.coalesce(F.try_element_at("x", i), F.lit(0.0)))
    return joined.select("key", vals.alias("vals"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), F.transform("embedding", lambda x: x.cast("double")).alias("vals"), "label")


def vector_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs (a, b) of neighbours in the order of vec_id, with both profiles."""
    v = vectors(spark, sf)
    step = v.select((F.col("key") - 1).alias("a"), F.col("key").alias("b"))
    return pairs.attach_profiles(step, v)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """(sample, a, b, score, is_decoy): pairs of suppliers by line items, scored by their mean quantity; every third pair is a decoy."""
    n = table(spark, sf, "supplier").count()
    x = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % n).alias("b"), "l_quantity")
    share = x.groupBy("a", "b").agg((F.avg("l_quantity") / 51).alias("x")).withColumn("is_decoy", (F.col("a") + F.col("b")) % 3 == 0)
    score = F.round(F.when(F.col("is_decoy"), F.col("x")).otherwise(F.sqrt("x")), 5)
    return share.select((F.col("a") % 10).alias("sample"), "a", "b", score.alias("score"), "is_decoy")


def directed(spark: SparkSession, sf: str, *by: str) -> DataFrame:
    """Edges from suppliers to suppliers by line items. With n items an edge weighs n / (n + m / 3), where m is the mean n of all edges."""
    n = table(spark, sf, "supplier").count()
    x = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % n).alias("dst"), *by).where("src <> dst")
    counted = x.groupBy(*by, "src", "dst").agg(F.count("*").alias("n"))
    mean = F.broadcast(counted.agg(F.avg("n").alias("mean")))  # one row
    return counted.join(mean).select(*by, "src", "dst", (F.col("n") / (F.col("n") + F.col("mean") / 3)).alias("weight"))


def edges(spark: SparkSession, sf: str, *by: str) -> DataFrame:
    x = directed(spark, sf, *by)
    return x.groupBy(*by, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("weight").alias("weight"))


def replicates(spark: SparkSession, sf: str) -> DataFrame:
    return edges(spark, sf, "l_returnflag").withColumnRenamed("l_returnflag", "replicate")


def matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Entries (i, j, v) of the directed edges from a weight of 0.75 on."""
    return directed(spark, sf).where("weight >= 0.75").select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("weight").alias("v"))


def long(df: DataFrame, *keys: str, vals: str = "vals") -> DataFrame:
    return df.select(*keys, F.posexplode(vals).alias("idx", "v")).withColumn("v", r6("v"))


def sheet(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("row_idx"), F.col("o_orderpriority").alias("cond"), F.year("o_orderdate").alias("repl"), F.col("o_custkey").cast("string").alias("short_id"))


# Sources and checks


def _matrix_file(spark: SparkSession, rows: DataFrame) -> str:
    """A matrix written as the text that measurements come in: zeros are empty cells. The file is in the order of ``rows``."""
    path = f"{shared_folder(spark)}/matrix-{uuid.uuid4().hex}"
    cells = [F.nullif(F.get("vals", F.lit(k)), F.lit(0.0)).alias(f"f{k}") for k in range(MONTHS)]
    sinks.write_tsv(rows.select(F.col("key").alias("GN"), *cells), path)
    return path


@query
def scan_matrix(spark, sf):
    return long(tables.read_matrix(spark, _matrix_file(spark, profiles(spark, sf))).withColumn("key", F.col("key").cast("long")), "key")


@query
def scan_matrix_legacy(spark, sf):
    """Every key twice, in one file: the last row stays, without its empty cells."""
    x = profiles(spark, sf)
    twice = x.withColumn("pass", F.lit(0)).union(x.select("key", F.transform("vals", lambda v: 2 * v), F.lit(1)))
    path = _matrix_file(spark, twice.orderBy("pass", "key").coalesce(1))
    return long(tables.read_matrix(spark, path, legacy=True).withColumn("key", F.col("key").cast("long")), "key")


@query
def sample_labels(spark, sf):
    return sheet(spark, sf).select(names.sample_label(F.col("cond"), F.col("repl").cast("string")).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query
def condition_last_id(spark, sf):
    return tables.condition_ids(sheet(spark, sf), "row_idx")


@query
def contaminant_freq(spark, sf):
    return profiles(spark, sf).select(F.col("key").alias("gene"), r6(tables.positive_share(F.col("vals"))).alias("freq"))


@query
def members_split(spark, sf):
    x = table(spark, sf, "part").select("p_partkey", names.pair_key(F.col("p_name"), F.col("p_type")).alias("mb"))
    m = names.members(F.col("mb"))
    return x.select("p_partkey", F.get(m, F.lit(0)).alias("a"), F.get(m, F.lit(1)).alias("b"))


@query
def joined_row(spark, sf):
    return tables.joined_rows(table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_size"), "p_partkey").select(F.col("key").alias("p_partkey"), "row")


@query
def collect_members(spark, sf):
    got = tables.collect_members(table(spark, sf, "nation"), "n_regionkey", "n_name")
    return got.select("n_regionkey", F.array_join("members", ";").alias("members"))


@query
def last_per_key(spark, sf):
    o = table(spark, sf, "orders")
    return tables.edge_per_key(o, "o_custkey", "o_orderpriority", "o_orderkey").select("src", "dst")


@query
def missing_tokens(spark, sf):
    t = F.split_part("p_name", F.lit(" "), F.lit(1))
    x = F.when(F.col("p_size") % 3 == 0, F.lit("na")).when(F.col("p_size") % 3 == 1, t).otherwise(F.col("p_size").cast("string"))
    return table(spark, sf, "part").select("p_partkey", tables.without_missing(x).alias("v"))


@query
def null_counts(spark, sf):
    x = table(spark, sf, "orders").select(F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).alias("price"), F.nullif("o_orderstatus", F.lit("F")).alias("status"), "o_custkey")
    return validate.null_counts(x)


@query
def duplicate_keys(spark, sf):
    return validate.duplicate_keys(sheet(spark, sf), ["repl", "short_id"])


@query
def explode_lists(spark, sf):
    x = table(spark, sf, "part").select("p_partkey", F.split("p_name", " ").alias("a"), F.split("p_type", " ").alias("b"))
    return tables.explode_lists(x, ["a", "b"]).groupBy("p_partkey", "a", "b").agg(F.count("*").alias("n"))


@query
def dense_ids(spark, sf):
    return tables.dense_ids(table(spark, sf, "customer"), "c_name")


# Profiles


@query
def min_support(spark, sf):
    v = F.transform("vals", lambda x: F.when(x > 150, x).otherwise(0.0))
    return profiles(spark, sf).select("key", p.support(v).alias("positive")).where("positive >= 2")


@query
def impute_gap(spark, sf):
    return long(profiles(spark, sf).withColumn("vals", p.impute_gap(F.col("vals"))), "key")


@query
def truncate_profile(spark, sf):
    return long(profiles(spark, sf).withColumn("vals", p.truncate(F.col("vals"), 60)), "key")


@query
def gaussian_smooth(spark, sf):
    return long(profiles(spark, sf).withColumn("vals", p.smooth(F.col("vals"))), "key")


@query
def resample_profile(spark, sf):
    return long(profiles(spark, sf).withColumn("vals", p.resample(F.col("vals"))), "key")


@query
def minmax_scale(spark, sf):
    return long(profiles(spark, sf).withColumn("vals", p.minmax(F.col("vals"))), "key")


@query
def normalize_profiles(spark, sf):
    x = profiles(spark, sf).where(p.support(F.col("vals")) >= 2)
    return long(x.withColumn("vals", p.normalize(F.col("vals"))), "key")


@query
def fill_zero(spark, sf):
    x = profiles(spark, sf).withColumn("vals", p.let(F.array_max("vals"), lambda top: F.transform("vals", lambda v: F.nullif(v, top))))
    return long(x.withColumn("vals", p.fill_zero(F.col("vals"))), "key")


@query
def local_maxima(spark, sf):
    return vectors(spark, sf).select("key", F.explode(p.local_maxima(F.col("vals"))).alias("at"))


@query
def argmax_by_group(spark, sf):
    return vectors(spark, sf).select("key", p.argmax(F.col("vals")).alias("at"))


@query
def peak_picking(spark, sf):
    x = profiles(spark, sf).select("key", p.normalize(F.col("vals")).alias("vals"))
    return signal.ready(x).select("key", F.explode(signal.peaks(F.col("vals"))).alias("peak"))


@query
def peak_split(spark, sf):
    x = profiles(spark, sf).select("key", p.normalize(F.col("vals")).alias("vals"))
    x = signal.ready(x).select("key", F.explode(signal.split_peaks(F.col("vals"))).alias("x"))
    return x.select("key", "x.part", F.posexplode("x.vals").alias("idx", "v"))


@query
def mean_positive(spark, sf):
    return vectors(spark, sf).select("key", r6(p.mean_if_positive(F.col("vals"))).alias("mean"))


@query
def fwhm(spark, sf):
    return profiles(spark, sf).select("key", p.fwhm(F.col("vals")).alias("fwhm"))


@query
def median(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(r6(F.median("l_extendedprice")).alias("median"))


@query
def percentile(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(r6(F.percentile("l_extendedprice", F.lit(0.9))).alias("p90"))


@query
def mean_sd(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(r6(F.avg("l_quantity")).alias("mean"), r6(F.stddev_samp("l_quantity")).alias("sd"))


@query
def renormalize(spark, sf):
    return table(spark, sf, "part").select("p_partkey", r6(p.renormalize(F.col("p_size").cast("double"), 1, 50, 0, 1)).alias("v"))


@query
def power_scale(spark, sf):
    return table(spark, sf, "part").select("p_partkey", r6(p.power_scale(F.col("p_size").cast("double"), F.lit(51.0), F.lit(0.0), 2.0)).alias("v"))


@query
def overlap(spark, sf):
    x = table(spark, sf, "part")
    return x.select("p_partkey", r6(p.overlap(F.split("p_name", ""), F.split("p_type", ""))).alias("share"))


@query
def combinations(spark, sf):
    n = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ";").alias("subunits(Gene name)"))
    return tables.complexes_to_pairs(n)


# Names and labels


@query
def confidence_label(spark, sf):
    x = directed(spark, sf)
    return x.select("src", "dst", names.confidence(F.col("weight")).alias("confidence"))


@query
def strip_peak_suffix(spark, sf):
    x = F.concat("s_name", F.lit("_p_"), (F.col("s_suppkey") % 20).cast("string"))
    return table(spark, sf, "supplier").select("s_suppkey", names.strip_peak_suffix(x).alias("name"))


@query
def name_prefix(spark, sf):
    x = F.concat("s_name", F.lit("_p_"), (F.col("s_suppkey") % 20).cast("string"))
    return table(spark, sf, "supplier").select("s_suppkey", names.prefix(x).alias("prefix"), names.after_last(x).alias("suffix"))


@query
def decoy_flag(spark, sf):
    x = F.when(F.col("s_suppkey") % 3 == 0, F.concat("s_name", F.lit("_DECOY"))).otherwise(F.col("s_name"))
    return table(spark, sf, "supplier").select("s_suppkey", names.is_decoy(x).alias("isdecoy"))


@query
def pair_key(spark, sf):
    x = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return x.select("n_nationkey", names.pair_key(F.col("n_name"), F.col("r_name")).alias("mb"), names.pair_key(F.col("n_name"), F.col("r_name"), True).alias("decoy_mb"))


# Pairs and features


@query
def corr_pairs(spark, sf):
    return pairs.correlated_pairs(vectors(spark, sf), 0.4).select("a", "b", r6("r").alias("r"))


@query
def condition_corr_pairs(spark, sf):
    """Correlated pairs within each of three conditions, in one job."""
    v = vectors(spark, sf).where("label is not null").withColumn("cond", F.pmod("label", F.lit(3)).cast("int"))
    return pairs.correlated_pairs(v, 0.4, by="cond").select("cond", "a", "b", r6("r").alias("r"))


@query
def cosine_similarity(spark, sf):
    return vector_pairs(spark, sf).select("a", "b", r6(p.cosine(F.col("fa"), F.col("fb"))).alias("cosine"))


@query
def pearson_pair(spark, sf):
    return vector_pairs(spark, sf).select("a", "b", r6(p.pearson(F.col("fa"), F.col("fb"))).alias("r"))


@query
def prior_semi(spark, sf):
    prior = directed(spark, sf).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    some = table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("key"))
    return pairs.prior_pairs(prior, some)


@query
def attach_profiles(spark, sf):
    return vector_pairs(spark, sf).select("a", "b", r6(p.total(F.col("fa"))).alias("sum_a"), r6(p.total(F.col("fb"))).alias("sum_b"))


@query
def pair_ids(spark, sf):
    x = Rounds(spark).keep(pairs.correlated_pairs(vectors(spark, sf), 0.4).select("a", "b"))
    return pairs.pair_table(x, pairs.decoy_pairs(vectors(spark, sf), x.count())).select("id", "a", "b", "mb")


@query
def pair_union(spark, sf):
    v = vectors(spark, sf)
    prior = v.select((F.col("key") - 1).alias("a"), F.col("key").alias("b"))
    x = Rounds(spark).keep(pairs.correlated_pairs(v, 0.4).select("a", "b"))
    return pairs.pair_table(x, pairs.decoy_pairs(v, x.count()), pairs.prior_pairs(prior, v)).groupBy("a", "b", "is_decoy").agg(F.count("*").alias("n"))


@query
def decoy_sample(spark, sf):
    v = vectors(spark, sf)
    return pairs.decoy_pairs(v, v.count())


@query
def abs_diff(spark, sf):
    return long(vector_pairs(spark, sf).withColumn("vals", p.abs_diff(F.col("fa"), F.col("fb"))), "a", "b")


@query
def peak_shift(spark, sf):
    return vector_pairs(spark, sf).select("a", "b", p.peak_shift(p.local_maxima(F.col("fa")), p.local_maxima(F.col("fb"))).alias("shft"))


@query
def common_peak(spark, sf):
    return vector_pairs(spark, sf).select("a", "b", p.common_peak(p.local_maxima(F.col("fa")), p.local_maxima(F.col("fb"))).alias("peak"))


@query
def aligned_peaks(spark, sf):
    x = vector_pairs(spark, sf).select("a", "b", F.array(p.local_maxima(F.col("fa")), p.local_maxima(F.col("fb"))).alias("x"))
    x = signal.ready(x, "a").select("a", "b", signal.align_peaks(F.col("x")).alias("x"))
    return x.select("a", "b", F.get("x", F.lit(0)).alias("peak_a"), F.get("x", F.lit(1)).alias("peak_b"))


@query
def min_sd_column(spark, sf):
    """Of the places of each label's vectors the one where they differ least."""
    at = vectors(spark, sf).select("label", F.posexplode("vals").alias("idx", "v")).groupBy("label", "idx").agg(F.round(F.stddev_samp("v"), 9).alias("sd"))
    return at.groupBy("label").agg(F.min_by("idx", F.struct("sd", "idx")).alias("idx"))


@query
def sliding_corr(spark, sf):
    return long(vector_pairs(spark, sf).withColumn("vals", signal.sliding_corr(F.col("fa"), F.col("fb"))), "a", "b").where("v is not null")


@query
def assemble_features(spark, sf):
    """Feature rows of neighbours, of which at most 0.075 is undefined."""
    v = vector_pairs(spark, sf)
    parts = (p.peak_shift(p.local_maxima(F.col("fa")), p.local_maxima(F.col("fb"))).alias("shft"), signal.sliding_corr(F.col("fa"), F.col("fb")).alias("cor"), p.abs_diff(F.col("fa"), F.col("fb")).alias("dif"))
    x = v.select(F.lit("").alias("id"), "a", "b", F.lit(False).alias("is_decoy"), *parts)
    return long(features.assemble(x, 0.075), "a", "b", vals="x")


@query
def scored_features(spark, sf):
    """Correlated pairs and decoys of normalized profiles, with features, scored by a regression fit on them."""
    v = keep(features.with_peaks(vectors(spark, sf).select("key", p.normalize(F.col("vals")).alias("vals"))))
    x = Rounds(spark).keep(pairs.correlated_pairs(v.select("key", "vals"), 0.2).select("a", "b"))
    decoys = pairs.decoy_pairs(v, x.count(), 0.2).select("a", "b", F.lit(True).alias("is_decoy"))
    rows = block_features.packed(x.withColumn("is_decoy", F.lit(False)).unionByName(decoys).where("a <> b"), v)
    return block_features.score(rows, block_features.fit(rows))


@query
def mcc(spark, sf):
    return table(spark, sf, "labels").agg(r6(features.mcc(F.col("quality"), 1 - F.col("toxic"))).alias("mcc"))


# Error control


@query
def empirical_pvalue(spark, sf):
    return fdr.p_values(scored(spark, sf)).select("sample", "score", F.col("nt").alias("n"), r6("pvalue").alias("pvalue"))


@query
def pi0_lambda(spark, sf):
    return fdr.pi0_counts(fdr.p_values(scored(spark, sf)), [0.0, 0.25, 0.5, 0.75]).select("sample", F.col("lambda").alias("lam"), r6("pi0").alias("pi0"))


@query
def pi0_smoother(spark, sf):
    return fdr.pi0(fdr.p_values(scored(spark, sf)), "smoother").select("sample", r6("pi0").alias("pi0"))


@query
def qvalue(spark, sf):
    return fdr.q_values(fdr.p_values(scored(spark, sf))).select("sample", r6("pvalue").alias("pvalue"), "n", r6("qvalue").alias("qvalue"))


@query
def bandwidth(spark, sf):
    return fdr.bandwidth(scored(spark, sf).withColumnRenamed("score", "x")).select("sample", r6("bw").alias("bw"))


@query
def error_table(spark, sf):
    return fdr.error_table(scored(spark, sf)).select("sample", "cutoff", "n", r6("pvalue").alias("pvalue"), r6("qvalue").alias("qvalue"))


@query
def local_fdr(spark, sf):
    return fdr.local_fdr(fdr.error_table(scored(spark, sf)))


@query
def fdr_cutoff(spark, sf):
    return fdr.cutoffs(fdr.error_table(scored(spark, sf)), 0.1)


@query
def nearest_cutoff(spark, sf):
    return fdr.nearest(fdr.error_table(scored(spark, sf)), [0.4, 0.5, 0.6, 0.7, 0.8]).select("sample", "at", "cutoff", r6("pvalue").alias("pvalue"), r6("qvalue").alias("qvalue"))


@query
def fdr_curve(spark, sf):
    return fdr.fdr_curve(scored(spark, sf)).select("sample", "score", *[r6(c).alias(c) for c in ("target", "decoy", "fdr")])


@query
def fdr_filter(spark, sf):
    return fdr.fdr_filter(scored(spark, sf), 0.3).select("sample", "a", "b", "score")


@query
def prob_histogram(spark, sf):
    return fdr.histogram(scored(spark, sf))


@query
def pnorm(spark, sf):
    """Upper tail of each target's score under a normal law of its sample's decoys."""
    x = scored(spark, sf)
    law = x.where("is_decoy").groupBy("sample").agg(F.avg("score").alias("m"), F.stddev_samp("score").alias("s"))
    return x.where("not is_decoy").join(law, "sample").select("sample", "a", "b", signal.upper_tail(F.col("score"), F.col("m"), F.col("s")).alias("p"))


# Networks


@query
def canonical_edges(spark, sf):
    return network.canonical(directed(spark, sf)).select("src", "dst", r6("weight").alias("weight"))


@query
def symmetrize(spark, sf):
    return network.symmetrize(directed(spark, sf)).select("src", "dst", r6("weight").alias("weight"))


@query
def distinct_vertices(spark, sf):
    return network.vertices(edges(spark, sf).where("weight >= 0.8"))


@query
def vertex_union(spark, sf):
    x = replicates(spark, sf).where("weight >= 0.7")
    a, r = (network.vertices(x.where(F.col("replicate") == k)) for k in "AR")
    return a.union(r).distinct()


@query
def replicate_outer(spark, sf):
    wide = network.replicate_table(replicates(spark, sf), ["A", "N", "R"])
    return wide.select("src", "dst", *[r6(f"weight_{k}").alias(f"weight_{k}") for k in range(3)])


@query
def outer_max(spark, sf):
    return network.outer_max(network.replicate_table(replicates(spark, sf), ["A", "N", "R"])).select("src", "dst", r6("weight").alias("weight"))


def _combined(mode: str):
    def run(spark, sf):
        return network.combine(replicates(spark, sf), 3, mode).select("src", "dst", r6("weight").alias("weight"))

    return run


QUERIES |= {f"combine_{m}": _combined(m) for m in ("max", "mean", "product")}


@query
def edge_frequency(spark, sf):
    return network.frequency(replicates(spark, sf), 3).select("src", "dst", r6("freq").alias("freq"))


@query
def desirability(spark, sf):
    x = replicates(spark, sf)
    both = network.frequency(x, 3, 0.7).join(network.combine(x, 3), ["src", "dst"])
    return both.select("src", "dst", r6(network.desirability(F.col("freq"), F.col("weight"))).alias("score"))


@query
def edge_list(spark, sf):
    return network.edge_list(edges(spark, sf), 0.75).select("prot_a", "prot_b", r6("comb_prob").alias("comb_prob"), "confidence")


@query
def neighbours(spark, sf):
    return network.neighbours(edges(spark, sf).where("weight >= 0.8")).orderBy("protein")


@query
def cross_condition_max(spark, sf):
    return network.cross_condition_max(edges(spark, sf, "l_linestatus").withColumnRenamed("l_linestatus", "cond"), "all").select("src", "dst", r6("weight").alias("weight"))


@query
def cross_condition_last(spark, sf):
    return network.cross_condition_max(edges(spark, sf, "l_linestatus").withColumnRenamed("l_linestatus", "cond"), "last").select("src", "dst", r6("weight").alias("weight"))


@query
def prune_vertices(spark, sf):
    return network.prune(edges(spark, sf), 0.8)[1]


@query
def contaminant_anti(spark, sf):
    freq = profiles(spark, sf).select(F.col("key").alias("gene"), tables.positive_share(F.col("vals")).alias("freq"))
    return network.drop_contaminants(edges(spark, sf), freq, 0.7).select("src", "dst", r6("weight").alias("weight"))


# Specificity


@query
def information_content(spark, sf):
    return edges(spark, sf).select("src", "dst", r6(specificity.information(F.col("weight"))).alias("ic"))


def _scores(spark, sf) -> DataFrame:
    m = network.symmetrize(edges(spark, sf).where("weight >= 0.75")).select(F.col("src").alias("i"), F.col("dst").alias("j"), specificity.information(F.col("weight")).alias("v"))
    return specificity.wd_scores(m, table(spark, sf, "supplier").count())


@query
def wd_score(spark, sf):
    return _scores(spark, sf).select("i", "j", r6("wd").alias("wd"))


@query
def condition_specificity(spark, sf):
    """Replicates of three conditions merged, and row scores in each condition's network, in one job."""
    told = edges(spark, sf, "l_returnflag", "l_linestatus").withColumn("sample", F.concat("l_returnflag", "l_linestatus"))
    samples = told.select("sample", F.col("l_returnflag").alias("cond"), F.col("l_linestatus").alias("replicate")).distinct()
    merged = pipeline.by_condition(told.select("sample", "src", "dst", "weight"), samples)
    found = pipeline.specificity_by_condition(merged, RunConfig(probability_floor=0.75))
    return found.select("cond", "i", "j", r6("wd").alias("wd"))


@query
def quantile_normalize(spark, sf):
    return specificity.quantile_normalize(_scores(spark, sf)).select("i", "j", r6("wd").alias("wd"))


@query
def wd_cutoff(spark, sf):
    """The cutoff for rows as long as the network's, and how many of its scores lie under it."""
    cut = specificity.null_cutoff(spark, table(spark, sf, "supplier").count())
    return _scores(spark, sf).join(F.broadcast(cut)).groupBy(r6("cutoff").alias("cutoff")).agg(F.count("*").alias("n"), F.count_if(F.col("wd") < F.col("cutoff")).alias("under"))


@query
def wd_filtered(spark, sf):
    n = table(spark, sf, "supplier").count()
    return specificity.apply_cutoff(_scores(spark, sf), specificity.null_cutoff(spark, n)).select("i", "j", r6("wd").alias("wd"))


@query
def upper_triangle(spark, sf):
    ids = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"))
    return specificity.upper_triangle(_scores(spark, sf), ids).select("prot_a", "prot_b", r6("wd").alias("wd"))


# Clusters


@query
def mcl_normalize(spark, sf):
    return cluster.normalize(matrix(spark, sf)).select("i", "j", r6("v").alias("v"))


@query
def mcl_inflate(spark, sf):
    return cluster.inflate(matrix(spark, sf), 2.0).select("i", "j", r6("v").alias("v"))


@query
def mcl_expand(spark, sf):
    return cluster.expand(cluster.normalize(matrix(spark, sf)), 2).select("i", "j", r6("v").alias("v"))


@query
def mcl_self_loops(spark, sf):
    return cluster.add_self_loops(matrix(spark, sf)).select("i", "j", r6("v").alias("v"))


@query
def mcl_prune(spark, sf):
    return cluster.prune(matrix(spark, sf), 0.8).select("i", "j", r6("v").alias("v"))


@query
def mcl_iterate(spark, sf):
    return cluster.iterate(cluster.normalize(matrix(spark, sf))).select("i", "j", r6("v").alias("v"))


def nation_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of a network of many parts: edges from a weight of 0.75 on whose suppliers are of one nation."""
    x, y = (table(spark, sf, "supplier").select(F.col("s_suppkey").alias(c), F.col("s_nationkey").alias(f"n_{c}")) for c in ("src", "dst"))
    inside = edges(spark, sf).where("weight >= 0.75").join(x, "src").join(y, "dst").where("n_src = n_dst")
    return network.symmetrize(inside).select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("weight").alias("v"))


@query
def mcl_clusters(spark, sf):
    return cluster.cluster_table(cluster.clusters(cluster.run_mcl_grid(nation_matrix(spark, sf), [2.0])).select("members"))


@query
def mcl_grid(spark, sf):
    """Clusters by inflation, all inflations in one job."""
    found = cluster.clusters(cluster.run_mcl_grid(nation_matrix(spark, sf), [1.5, 2.0, 3.0]), ("inflation",))
    return found.select("inflation", F.array_join(F.transform("members", lambda x: x.cast("string")), ";").alias("members"))


@query
def connected_parts(spark, sf):
    return components(nation_matrix(spark, sf))


@query
def modularity(spark, sf):
    ids = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    found = ids.groupBy("s_nationkey").agg(F.array_sort(F.collect_list("s_suppkey")).alias("members")).select("members")
    m = network.symmetrize(edges(spark, sf).where("weight >= 0.75")).select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("weight").alias("v"))
    return cluster.modularity(m, found).select(r6("q").alias("q"))


@query
def layered_factors(spark, sf):
    m = network.symmetrize(edges(spark, sf)).select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("weight").alias("v"))
    return cluster.layered_factors(m)[0]


@query
def deep_factors(spark, sf):
    """Factors of a network of many parts in a chain of two layers, absent edges counting as zeros."""
    return factors.deep_factors(nation_matrix(spark, sf), rounds=10)[0].select("id", "cluster")


@query
def profile_network(spark, sf):
    """From profiles to a network: normalized, correlated, and listed with a confidence."""
    x = profiles(spark, sf).where(p.support(F.col("vals")) >= 2)
    r = pairs.correlated_pairs(x.select("key", p.normalize(F.col("vals")).alias("vals")), 0.2)
    return network.edge_list(r.select(F.col("a").alias("src"), F.col("b").alias("dst"), ((F.col("r") + 1) / 2).alias("weight"))).select("prot_a", "prot_b", r6("comb_prob").alias("comb_prob"), "confidence")
