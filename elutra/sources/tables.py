"""Sources: tab-separated matrices, sample sheets and the tables between stages, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from elutra.functions import names
from elutra.sources.validate import MissingColumnError

#: What counts as missing in feature tables.
MISSING = ("nan", "na", "", "None", "n", "-")

SHEET = T.StructType([T.StructField(n, t) for n, t in (("Sample", T.StringType()), ("cond", T.StringType()), ("group", T.IntegerType()), ("short_id", T.StringType()), ("repl", T.IntegerType()), ("fr", T.IntegerType()))])
CALIBRATION = T.StructType([T.StructField("position", T.IntegerType()), T.StructField("mass", T.DoubleType())])
SCORED = T.StructType([T.StructField("prot_a", T.StringType()), T.StructField("prot_b", T.StringType()), T.StructField("prob", T.DoubleType()), T.StructField("isdecoy", T.StringType())])


def tsv(spark: SparkSession, path: str, schema: T.StructType | None = None, header: bool = True) -> DataFrame:
    reader = spark.read.option("sep", "\t").option("header", header)
    return (reader.schema(schema) if schema else reader).csv(path)


def with_row_order(df: DataFrame, out: str = "row_idx") -> DataFrame:
    """Rows marked in the order of the files they were read from."""
    return df.withColumn(out, F.monotonically_increasing_id())


def last_wins(df: DataFrame, key: str, value: str | Column, order: str, out: str) -> DataFrame:
    """One row for each key: its last value."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(out))


def as_profiles(wide: DataFrame, key: str = "GN", strict: bool = True) -> DataFrame:
    """(key, vals): the columns but ``key`` as an array of doubles, in their order. Strict: what is no number raises."""
    columns = [c for c in wide.columns if c not in (key, "row_idx")]
    number = lambda c: F.col(f"`{c}`").cast("double") if strict else F.col(f"`{c}`").try_cast("double")
    return wide.select(F.col(key).alias("key"), F.array(*[number(c) for c in columns]).alias("vals"))


def read_matrix(spark: SparkSession, path: str, key: str = "GN", legacy: bool = False) -> DataFrame:
    """(key, vals) of a wide table. In legacy mode runs of tabs count as one, so that empty cells
    shift the rest to the left, and the last of several rows with one key stays."""
    if not legacy:
        return as_profiles(tsv(spark, path), key)
    lines = with_row_order(spark.read.text(path)).withColumn("cells", F.split(F.regexp_replace("value", "\\s+$", ""), "\t+"))
    head = lines.where(F.get("cells", F.lit(0)) == key).orderBy("row_idx").limit(1).select(F.size("cells").alias("n")).first()
    if head is None:
        raise MissingColumnError(f"no line of {path} starts with {key}")
    rows = lines.where(F.get("cells", F.lit(0)) != key)
    vals = F.transform(F.slice("cells", 2, head["n"] - 1), lambda x: x.cast("double"))
    return last_wins(rows.select(F.get("cells", F.lit(0)).alias("key"), vals.alias("v"), "row_idx"), "key", "v", "row_idx", "vals")


def read_matrices(spark: SparkSession, files: list[tuple[str, str]], key: str = "GN", legacy: bool = False) -> DataFrame:
    """(sample, key, vals) of all ``files`` [(sample, path)], in one scan however many they are.

    Each file has a heading of its own, the line with the cell ``key``; cells are apart by tabs and not quoted. Legacy mode is that of ``read_matrix``.
    """

    def address(path: str) -> str:
        found = spark._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(found).toUri().toString()

    same = lambda c: F.regexp_replace(c, "^([^:/]+):/+", "$1:/")
    of = F.broadcast(spark.createDataFrame([(s, address(p)) for s, p in files], "sample string, _path string"))  # a row for each file of the sheet
    lines = with_row_order(spark.read.text([p for _, p in files]).select("value", F.col("_metadata.file_path").alias("_file")))
    cells = F.split(F.regexp_replace("value", "\\s+$", ""), "\t+") if legacy else F.split("value", "\t")
    rows = lines.where("value <> ''").withColumn("cells", cells).join(of, same(F.col("_file")) == same(F.col("_path"))).select("sample", "row_idx", "cells")
    at = F.array_position("cells", F.lit(key)).cast("int")
    is_head = (F.get("cells", F.lit(0)) == key) if legacy else at > 0
    heads = F.broadcast(rows.where(is_head).groupBy("sample").agg(F.min_by(F.struct(at.alias("at"), F.size("cells").alias("n")), "row_idx").alias("head"), F.min("row_idx").alias("_first")))
    body = rows.join(heads, "sample")
    if legacy:  # the heading may come again
        vals = F.transform(F.slice("cells", 2, F.col("head.n") - 1), lambda x: x.cast("double"))
        body = body.where(~is_head).select("sample", F.get("cells", F.lit(0)).alias("key"), vals.alias("v"), "row_idx")
        return body.groupBy("sample", "key").agg(F.max_by("v", "row_idx").alias("vals"))
    places = F.filter(F.sequence(F.lit(1), F.col("head.n")), lambda k: k != F.col("head.at"))
    vals = F.transform(places, lambda k: F.nullif(F.get("cells", k - 1), F.lit("")).cast("double"))
    return body.where("row_idx > _first").select("sample", F.get("cells", F.col("head.at") - 1).alias("key"), vals.alias("vals"))


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    return tsv(spark, path, SHEET)


def sample_labels(sheet: DataFrame) -> DataFrame:
    """(Sample, label): condition and replicate of each sample."""
    return sheet.select("Sample", names.sample_label(F.col("cond"), F.col("repl").cast("string")).alias("label"))


def condition_ids(sheet: DataFrame, order: str) -> DataFrame:
    """(cond, short_id): the last short_id of each condition."""
    return last_wins(sheet, "cond", "short_id", order, "short_id")


def read_prior(spark: SparkSession, path: str) -> DataFrame:
    """(a, b): the two columns of a prior network, by place."""
    return tsv(spark, path).toDF("a", "b")


def complexes_to_pairs(complexes: DataFrame, members: str = "subunits(Gene name)") -> DataFrame:
    """(a, b): all pairs of members of each complex, for complexes of moderate size."""
    m = complexes.select(F.array_sort(F.array_distinct(F.split(F.col(f"`{members}`"), ";"))).alias("m"))
    first = m.select("m", F.posexplode("m").alias("i", "a"))
    return first.select("a", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("b")).distinct()


def contaminant_frequency(table: DataFrame, key: str = "Gene", skip: tuple[str, ...] = ("RefSeq", "UniProt")) -> DataFrame:
    """(gene, freq): the share of control columns with a positive count."""
    counts = F.array(*[F.col(f"`{c}`").cast("double") for c in table.columns if c not in (key, *skip)])
    return table.select(F.col(key).alias("gene"), positive_share(counts).alias("freq"))


def positive_share(counts: Column) -> Column:
    return F.try_divide(F.size(F.filter(counts, lambda x: x > 0)).cast("double"), F.size(counts))


def joined_rows(wide: DataFrame, key: str, sep: str = "#") -> DataFrame:
    """(key, row): all other columns in one string."""
    return wide.select(F.col(key).alias("key"), F.concat_ws(sep, *[F.col(f"`{c}`").cast("string") for c in wide.columns if c != key]).alias("row"))


def peak_lists(peaks: DataFrame) -> DataFrame:
    """(ID, peaks): a map from member to its peak and choice, from rows (ID, MB, PKS, SEL)."""
    entry = F.struct("MB", F.concat_ws("\t", "PKS", "SEL").alias("v"))
    return peaks.groupBy("ID").agg(F.map_from_entries(F.array_sort(F.collect_set(entry))).alias("peaks"))


def collect_members(df: DataFrame, key: str, member: str) -> DataFrame:
    return df.groupBy(key).agg(F.array_sort(F.collect_list(member)).alias("members"))


def edge_per_key(df: DataFrame, a: str, b: str, order: str | None = None) -> DataFrame:
    """(src, dst) rows of a list; with ``order`` only the last one of each src, as a key-value reader would keep."""
    rows = df.select(F.col(a).alias("src"), F.col(b).alias("dst"), *([order] if order else []))
    return rows if order is None else last_wins(rows, "src", "dst", order, "dst")


def predictions(df: DataFrame, order: str) -> DataFrame:
    """(ID, pos): the last positive probability of each id."""
    return last_wins(df, "ID", F.col("POS").cast("double"), order, "pos")


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    return tsv(spark, path, CALIBRATION, header=False)


def without_missing(value: Column) -> Column:
    """NULL for the tokens that count as missing, else the number."""
    return F.when(~value.isin(*MISSING), value.try_cast("double"))


def explode_lists(df: DataFrame, columns: list[str], fill: str = "") -> DataFrame:
    """Lists side by side, one row for each place; rows with empty lists stay, with ``fill``."""
    rest = [c for c in df.columns if c not in columns]
    at = df.withColumn("_x", F.explode_outer(F.arrays_zip(*columns)))
    return at.select(*rest, *[F.coalesce(F.col(f"_x.{c}"), F.lit(fill)).alias(c) for c in columns])


def dense_ids(df: DataFrame, key: str) -> DataFrame:
    """(key, id): distinct keys numbered from 1 in order."""
    from elutra.operators.pairs import number

    return number(df.select(key).distinct(), key).select(key, (F.col("row") + 1).alias("id"))


def numbered(df: DataFrame, by: str, *order: str) -> DataFrame:
    return df.withColumn("at", F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1)
