"""Quality by a sparse rule ensemble (RuleFit, Friedman and Popescu 2008) over text statistics.

Trees are grown on statistics of labelled texts; every path to a node is a rule, a conjunction
of comparisons. A logistic regression with a lasso penalty weighs the rules and drops most. The
rules left are compiled into one column expression over the statistics of a text.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from elutra.llm.shared import per_text, stable

#: Of the labelled rows the fit takes at most so many, those with the smallest hashes of doc_id.
MAX_ROWS = 20_000
TREES, DEPTH, LASSO = 16, 3, 0.001

Rule = tuple[tuple[str, str, float], ...]  # (statistic, "<=" or ">", value) all hold


NAMES = ["n_chars", "n_words", "word_length", "distinct_words", "distinct_lines", "line_length", "symbols", "capitals", "stops", "bangs", "digits"]
#: ASCII characters by what they are counted as; letters beyond ASCII that are capitals.
SYMBOLS, CAPITALS, STOPS, DIGITS = b"#$%&*+/<=>@[\\]^_`{|}~", bytes(range(65, 91)), b".,;:?", b"0123456789"
WIDE_CAPITALS = re.compile("[\u00c0-\u00d6\u00d8-\u00de\u0391-\u03a9\u0410-\u042f]")


def measure(text: str) -> tuple[float, ...]:
    """The statistics NAMES of a whole text; those of an empty one are all 0."""
    if not text:
        return (0.0,) * len(NAMES)
    data, n = text.encode("utf-8", "replace"), len(text)
    count = lambda kind: len(data) - len(data.translate(None, kind))
    words, lines = text.split(), text.split("\n")
    capitals = count(CAPITALS) + (0 if text.isascii() else len(WIDE_CAPITALS.findall(text)))
    return (
        float(n),
        float(len(words)),
        n / max(len(words), 1),
        # Herdan's C: unlike a plain share, it hardly falls with the length of a text.
        math.log1p(len(set(words))) / math.log1p(max(len(words), 1)),
        len(set(lines)) / len(lines),
        n / len(lines),
        count(SYMBOLS) / n,
        capitals / n,
        count(STOPS) / n,
        count(b"!") / n,
        count(DIGITS) / n,
    )


def statistics(text: Column) -> Column:
    """Struct of the statistics NAMES of each text, as doubles; null counts as empty."""
    return per_text(lambda: measure, ", ".join(f"{n} double" for n in NAMES), NAMES)(text)


@dataclass(frozen=True)
class Model:
    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def column(self, stats: dict[str, Column]) -> Column:
        """The score, 0 to 1, as one expression over columns of statistics."""
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            total = total + F.when(_holds(rule, stats), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def _holds(rule: Rule, stats: dict[str, Column]) -> Column:
    held = F.lit(True)
    for name, side, value in rule:
        held = held & (stats[name] <= value if side == "<=" else stats[name] > value)
    return held


def _paths(node, names: list[str], path: Rule = ()) -> list[Rule]:
    """The rules of all nodes below ``node``; a bound made closer further down replaces the wider one."""
    if node.getClass().getSimpleName() == "LeafNode":
        return []
    name, value = names[node.split().featureIndex()], float(node.split().threshold())
    found = []
    for side, child in (("<=", node.leftChild()), (">", node.rightChild())):
        own = tuple(sorted({(x, s): v for x, s, v in (*path, (name, side, value))}.items()))
        rule = tuple((x, s, v) for (x, s), v in own)
        found += [rule, *_paths(child, names, rule)]
    return found


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, lasso: float = LASSO) -> Model:
    """A model from rows of ``docs`` (doc_id, text) that ``labels`` (doc_id, quality 0 or 1) marks.

    Null labels are left out; of rows that share a doc_id the least text counts. If only one label is there, every text gets a score on its side of
    0.5; without labels, all get 1 (nothing is known against them).
    """
    sample = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # at most max_rows rows
    names = NAMES
    x = rows.select("doc_id", F.col("label").cast("double").alias("label"), statistics(F.col("text")).alias("x"))
    # Measured by all tasks that read texts; the few rows found are then fit in a few partitions.
    found = stable(x.select("doc_id", "label", F.array(*[f"x.{n}" for n in names]).alias("stats")))
    train = found.coalesce(4).sortWithinPartitions("doc_id", "stats").persist()
    try:
        seen = {r["label"] for r in train.select("label").distinct().collect()}
        if len(seen) < 2:
            return Model(-3.0 if seen == {0.0} else 3.0, ())
        forest = RandomForestClassifier(featuresCol="x", numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="0.5", subsamplingRate=0.7, seed=11).fit(train.select("label", array_to_vector("stats").alias("x")))
        rules = sorted({rule for tree in forest._java_obj.trees() for rule in _paths(tree.rootNode(), names)})
        stat = {name: F.col("stats")[i] for i, name in enumerate(names)}
        held = train.select("label", array_to_vector(F.array(*[_holds(r, stat).cast("double") for r in rules])).alias("x"))
        lr = LogisticRegression(featuresCol="x", elasticNetParam=1.0, regParam=lasso, standardization=False, maxIter=60).fit(held)
        return Model(float(lr.intercept), tuple((r, float(w)) for r, w in zip(rules, lr.coefficients.toArray(), strict=True) if w != 0))
    finally:
        train.unpersist()


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 if score >= 0.5) for every row of ``docs``.

    One narrow pass: statistics of whole texts, and the rules as one expression over them.
    Repeated rows repeat, other columns are ignored; null texts score as empty ones.
    """
    known = docs.select("doc_id", statistics(F.col("text")).alias("stats"))
    scored = known.select("doc_id", model.column({n: F.col(f"stats.{n}") for n in NAMES}).alias("score"))
    return scored.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is at least ``least``; null texts score as empty ones."""
    own = "_quality_statistics"
    while own in docs.columns:
        own += "_"
    return docs.withColumn(own, statistics(F.col("text"))).where(model.column({n: F.col(f"{own}.{n}") for n in NAMES}) >= least).drop(own)
