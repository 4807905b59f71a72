"""Near copies of whole documents: exact Jaccard similarity of their sets of five-word shingles.

SimHash fingerprints of the sets, searched in vantage-point trees, find most links. What they may
miss a prefix filter finds, which misses no pair: sets are read in one order common to all
documents; of two sets with a similarity of 0.8 at least, each has one of the shared shingles among
its first n - ceil(0.8 n) + 1. Any order will do; here shingles that are frequent in a sample of the
documents come last, so that a line found in many documents makes no candidates. Candidates are
left out only where similarity is impossible: counts of a set's shingles in hashed bins, some two
a bin, bound what two sets share by the sum of the lesser counts. Every other link is verified on
the whole sets, in a join.

A large group of near copies that are linked doesn't cost its square: the trees give links that span
it, and only documents that these don't join are compared any further: first in rounds of stars, each
with one other for each shingle of their prefix, the one with least of its own, and then those pairs
that are still in different components and that the bounds allow.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from elutra.llm import simhash
from elutra.llm.components import components
from elutra.llm.shared import per_text, small_side, stable

WIDTH = 5
#: The order of shingles is made from about so many documents, or from this share if that is more, and puts at most so
#: many last: those in OFTEN documents of the sample or more. It decides the cost only.
SAMPLE, SHARE, MAX_OFTEN, OFTEN = 4096, 1 / 64, 100_000, 4
#: Fingerprints of sets with a similarity of 0.8 differ in 10 bits or so. Links of at most 12 are candidates; the trees seek
#: those with a part that differs in one bit at most.
RULE = simhash.Rule(reach=12, trees=4, near=1)
#: At most so many rounds of stars come before pairs are listed. It decides the cost only.
ROUNDS = 2
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's runs of five words; of all words if they are fewer; none without words."""
    words = text.encode("utf-8", "replace").lower().split()  # ASCII letters and white space only
    if not words:
        return np.zeros(0, np.int64)
    if len(words) < WIDTH:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64).view(np.int64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(own) - WIDTH + 1
    mixed = np.zeros(n, np.uint64)
    for k in range(WIDTH):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX + own[k : k + n]
    return np.unique(((mixed ^ (mixed >> np.uint64(32))) * _MIX).view(np.int64))


def prefix(own: np.ndarray, often: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The first n - ceil(0.8 n) + 1 of a sorted set in the common order; ``often`` is sorted and has its places in ``ranks``."""
    n = len(own)
    if n and len(often):
        at = np.minimum(np.searchsorted(often, own), len(often) - 1)
        own = own[np.argsort(np.where(often[at] == own, ranks[at], -1), kind="stable")]
    return own[: n - (4 * n + 4) // 5 + 1] if n else own


def _often(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are frequent in a sample, sorted, and how many of its documents have each."""
    share = max(SHARE, min(1.0, SAMPLE / max(1, docs.count())))
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    found = per_text(lambda: lambda value: (shingles(value),), "x array<long>", ["x"])(F.col("text"))["x"]
    each = sample.select(F.explode(found).alias("token")).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)
    got = each.orderBy(F.desc("n"), "token").limit(MAX_OFTEN).toPandas().sort_values("token")
    return got["token"].to_numpy(np.int64), got["n"].to_numpy(np.int64)


def _kept(df: DataFrame) -> DataFrame:
    """``df`` written down; before that, what earlier steps have shuffled and nothing refers to any more is deleted."""
    df.sparkSession.sparkContext._jvm.java.lang.System.gc()
    return stable(df)


def _similar(n: Column, m: Column, shared: Column) -> Column:
    """Whether sets of n and m with so many in common have a Jaccard similarity of 0.8 at least."""
    return 9 * shared >= 4 * (n + m)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets (node, own) are similar."""
    x, y = (sets.select(F.col("node").alias(c), F.col("own").alias(f"own_{c}")) for c in "ab")
    shared = F.size(F.array_intersect("own_a", "own_b"))
    return pairs.join(x, "a").join(y, "b").where(_similar(F.size("own_a"), F.size("own_b"), shared)).select("a", "b")


def _node(own: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)


def _fingerprint(own: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(own), 1 << 16):
        ones += np.unpackbits(own[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(own), bitorder="little").view("<i8")[0])


def _bins(own: np.ndarray) -> bytes:
    """How many of a set are in each of some len / 2 bins, a power of two; b"" if a count passes a byte."""
    k = 1 << max(0, len(own).bit_length() - 2)
    counts = np.bincount(own & (k - 1), minlength=k)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def _most_shared(x: bytes, y: bytes) -> int:
    """A bound on what the sets of two non-empty bins share. Of unequal numbers of bins the more are added up to the fewer."""
    a, b = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    return int(np.minimum(a, b.reshape(-1, len(a)).sum(axis=0, dtype=np.int64)).sum(dtype=np.int64))


@F.pandas_udf(BooleanType())
def _may_be_similar(n: pd.Series, m: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series([not a or not b or 9 * min(_most_shared(a, b), p, q) >= 4 * (p + q) for p, q, a, b in zip(n, m, x, y, strict=True)], dtype=bool)


def _stars(index: DataFrame, k: int, possible: Callable[[str, str], Column]) -> DataFrame:
    """Each row of ``index`` (token, node, c, spot) with the best of its token in another component, as pairs (a, b).

    The best have the fewest rare shingles before the token, so least of their own. After the first
    round it is the best of half the nodes, another half each time, as pairs that failed do so again.
    """
    whole = Window.partitionBy("token")
    own = F.struct((F.col("spot").bitwiseAND(F.lit((1 << 32) - 1)) / F.shiftright("spot", 32)).alias("share"), "c", "node", "spot")
    best = index.withColumn("own", own if k == 0 else F.when(F.pmod(F.xxhash64("node", F.lit(k)), F.lit(2)) == 0, own))
    best = best.withColumn("first", F.min("own").over(whole))
    best = best.withColumn("second", F.min(F.when(F.col("c") != F.col("first.c"), F.col("own"))).over(whole))
    best = best.withColumn("one", F.when(F.col("c") != F.col("first.c"), F.col("first")).otherwise(F.col("second"))).where("one is not null")
    best = best.select("node", "spot", F.col("one.node").alias("one"), F.col("one.spot").alias("one_spot")).where(possible("spot", "one_spot"))
    return best.select(F.greatest("node", "one").alias("a"), F.least("node", "one").alias("b")).distinct()


def group(docs: DataFrame) -> DataFrame:
    """doc_id and component_id for every row of ``docs`` (doc_id, text) with a doc_id.

    component_id is the smallest doc_id that can be reached over links of documents whose sets of
    five-word shingles have a Jaccard similarity of 0.8 or more. Texts without words, and null
    ones, are copies of each other. Repeated rows repeat; other columns are ignored. An empty table
    stays empty.
    """
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    often = docs.sparkSession.sparkContext.broadcast(_often(docs))

    def read():
        tokens, counts = often.value

        def one(value: str) -> tuple:
            own = shingles(value)
            return _node(own), len(own), _fingerprint(own), _bins(own), prefix(own, tokens, counts)

        return one

    of_docs = docs.select("doc_id", per_text(read, "node long, n long, fp long, bins binary, prefix array<long>", ["node", "n", "fp", "bins", "prefix"])(F.col("text")).alias("x"))
    of_docs = _kept(of_docs.select("doc_id", "x.*"))
    nodes = _kept(of_docs.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("fp").alias("fp")))
    repeated = of_docs.groupBy("doc_id").count().where("count > 1").select("doc_id")  # ids of several rows

    again = small_side(_kept(repeated))
    several_rows = not again.isEmpty()

    def read_sets():
        def one(value: str) -> tuple:
            own = shingles(value)
            return _node(own), own

        return one

    def sets(pairs: DataFrame) -> DataFrame:
        """The whole sets of the pairs' nodes, from the text of one document each."""
        asked = pairs.select(F.explode(F.array("a", "b")).alias("asked")).distinct()
        asked = _kept(asked.join(nodes.select(F.col("node").alias("asked"), F.col("first").alias("doc_id")), "asked"))
        own = per_text(read_sets, "node long, own array<long>", ["node", "own"])(F.col("text"))
        found = docs.join(small_side(asked), "doc_id").select("doc_id", "asked", own.alias("x")).select("doc_id", "asked", "x.*")
        found = _kept(found.where("node = asked").select("doc_id", "node", "own"))
        if not several_rows:
            return found.select("node", "own")
        several = found.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "node"])  # of repeated rows one
        return found.join(again, "doc_id", "left_anti").union(several.select("doc_id", "node", "own")).select("node", "own")

    def plausible(pairs: DataFrame) -> DataFrame:
        """Without those that the bins rule out. Bins come from the document that stands for a node."""
        pairs = _kept(pairs)
        asked = small_side(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        own = of_docs.join(asked, "node", "left_semi").join(nodes.select("node", F.col("first").alias("doc_id")), ["node", "doc_id"], "left_semi")
        own = own.select("node", "n", "bins")
        if several_rows:
            own = own.dropDuplicates(["node"])
        x, y = (own.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("bins").alias(f"bins_{c}")) for c in "ab")
        return pairs.join(x, "a").join(y, "b").where(_may_be_similar("n_a", "n_b", "bins_a", "bins_b")).select("a", "b")

    # Links that the trees find.
    with_words = nodes.where("n > 0")
    asked = simhash.links(with_words.select("node", "fp"), with_words.count(), RULE)
    asked = _kept(plausible(asked.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()))
    near = _kept(_verified(asked, sets(asked)))
    of_node = components(near)

    # Shingles of documents in several components. Rows of (token, node, c, spot): c is the component, a spot the size of
    # the set and the place in it, in one number to keep rows short.
    index = of_docs.where("n > 1").select("doc_id", "node", "n", "prefix").join(small_side(nodes.select("node", F.col("first").alias("doc_id"))), ["doc_id", "node"], "left_semi")
    index = index.join(small_side(_kept(of_node)), "node", "left").select("node", "n", F.coalesce("component", "node").alias("c"), F.posexplode("prefix").alias("at", "token"))
    index = index.select("token", "node", "c", F.shiftleft("n", 32).bitwiseOR(F.col("at").cast("long")).alias("spot"))
    whole = Window.partitionBy("token")

    def open_at(rows: DataFrame) -> DataFrame:
        """Rows of tokens whose documents are in different components yet; repeated rows are harmless."""
        return rows.withColumns({"low": F.min("c").over(whole), "high": F.max("c").over(whole)}).where("low <> high").select("token", "node", "c", "spot")

    def possible(spot: str, other: str) -> Column:
        """By sizes, and by how much is left from the first shared shingle on."""
        (n, at), (m, to) = ((F.shiftright(c, 32), F.col(c).bitwiseAND(F.lit((1 << 32) - 1))) for c in (spot, other))
        return _similar(n, m, F.least(n - at, m - to))

    index, tried = _kept(open_at(index)), asked
    for k in range(ROUNDS):
        stars = _kept(plausible(_stars(index, k, possible)).join(tried, ["a", "b"], "left_anti"))
        tried = tried.union(stars)
        more = None if stars.isEmpty() else _kept(_verified(stars, sets(stars)))
        if more is None or more.isEmpty():
            break
        near = near.union(more)
        of_node = _kept(components(near))
        # What is open yet goes on with its new components.
        index = index.drop("c").join(small_side(of_node), "node", "left").select("token", "node", F.coalesce("component", "node").alias("c"), "spot")
        index = _kept(open_at(index))

    # What the stars have left open: pairs of a shingle in different components.
    x, y = index.toDF("token", "a", "c", "spot"), index.toDF("token", "b", "d", "other")
    pairs = x.join(y, "token").where("a > b and c <> d").where(possible("spot", "other"))
    pairs = _kept(plausible(pairs.select("a", "b").distinct()).join(tried, ["a", "b"], "left_anti"))
    if not pairs.isEmpty():
        more = _kept(_verified(pairs, sets(pairs)))
        if not more.isEmpty():
            of_node = components(near.union(more))
    small = of_node.join(nodes, "node").groupBy("component").agg(F.min("first").alias("component_id"))
    of_node = of_node.join(small, "component").select("node", "component_id")
    known = nodes.join(of_node, "node", "left").select("node", F.coalesce("component_id", "first").alias("component_id"))
    return of_docs.select("doc_id", "node").join(known, "node").select("doc_id", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose doc_id is the smallest of their group of near copies.

    Rows that share a doc_id are one document, of which one row stays. Rows without doc_id stay.
    """
    found = group(docs)
    found = stable(found.groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count("*").alias("rows")))
    copies = small_side(found.where("doc_id <> component_id").select("doc_id"))
    kept = docs.join(copies, "doc_id", "left_anti").select(docs.columns)
    repeated = found.where("rows > 1").select("doc_id")
    if repeated.isEmpty():
        return kept
    again = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns)
    return kept.join(repeated, "doc_id", "left_anti").select(docs.columns).union(again)
