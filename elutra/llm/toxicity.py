"""Toxicity severity by cumulative-link ordinal regression on sparse word features.

P(severity <= k) = sigmoid(threshold_k - w.x): one weight vector, ordered thresholds. The label
says only toxic or not, so grades are made from it: toxic rows are ranked by the weight of their
words under a first two-grade fit and cut into thirds (mild, moderate, severe); other rows have
grade 0. The expected severity is the sum over k of P(severity > k).

The fit takes a bounded sample of each class. As it so sees another share of toxic rows than there
is, its rows weigh as many labels as each stands for; p_toxic means the same for every number of labels.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from elutra.llm.shared import per_text, stable

WORDS = re.compile(r"[^\W\d_]+")
#: Besides itself, a word counts by its beginning of so many letters, marked "^".
STEMS = (5, 7)
#: Of the labelled rows, how many the fit takes at most: of toxic rows and of others.
MAX_TOXIC, MAX_OTHER = 1500, 3000
#: Words found in fewer rows of that sample are no features, and of the rest so many at most are.
MIN_ROWS, MAX_FEATURES = 6, 2000


def count_features(text: str, known: dict[str, float] | None = None) -> Counter:
    """How often each feature occurs in ``text``; only those in ``known``, if that is given."""
    found: Counter = Counter()
    for word, n in Counter(WORDS.findall(text.lower())).items():
        for x in (word, *["^" + word[:k] for k in STEMS if len(word) > k]):
            if known is None or x in known:
                found[x] += n
    return found


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    thresholds: tuple[float, ...]

    def severity(self, text: str) -> tuple[float, float, list[str]]:
        """Expected severity, P(severity >= 1), and the words that raise it most."""
        known = self.weights
        hits = count_features(text, known)
        total = sum(known[w] * np.log1p(n) for w, n in hits.items())
        above = 1 / (1 + np.exp(np.clip(np.array(self.thresholds) - total, -60, 60)))
        worst = sorted((w for w in hits if known[w] > 0), key=lambda w: (-known[w] * np.log1p(hits[w]), w))[:5]
        return float(above.sum()), float(above[0]), worst


def _fit(rows: list[np.ndarray], counts: list[np.ndarray], grade: np.ndarray, n_features: int, n_grades: int, l1: float, weight: np.ndarray, steps: int = 250) -> tuple[np.ndarray, np.ndarray]:
    """Proximal gradient with momentum on the likelihood of ordered grades, of rows that count by ``weight``; weights of features are shrunk to zero by ``l1``."""
    index = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    value = np.concatenate(counts) if rows else np.zeros(0)
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    at_least = (grade[:, None] > np.arange(n_grades - 1)[None, :]).astype(float)
    share = weight / weight.sum()
    w, first, gaps = np.zeros(n_features), 2.0, np.zeros(n_grades - 2)
    mw, vw, mt, vt = np.zeros_like(w), np.zeros_like(w), np.zeros(n_grades - 1), np.zeros(n_grades - 1)
    for step in range(1, steps + 1):
        theta = first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        eta = np.bincount(of, value * w[index], minlength=len(rows))
        above = 1 / (1 + np.exp(np.clip(theta[None, :] - eta[:, None], -60, 60)))
        off = (above - at_least) * share[:, None]  # of the sum of the thresholds' log losses
        gw = np.bincount(index, value * off.sum(1)[of], minlength=n_features)
        gt = -off.sum(0)
        g = np.concatenate([[gt.sum()], np.exp(gaps) * np.cumsum(gt[::-1])[::-1][1:]])
        mw, vw, mt, vt = 0.9 * mw + 0.1 * gw, 0.99 * vw + 0.01 * gw**2, 0.9 * mt + 0.1 * g, 0.99 * vt + 0.01 * g**2
        a, b = 1 - 0.9**step, 1 - 0.99**step
        pace = 0.1 / (np.sqrt(vw / b) + 1e-4)
        w = w - pace * mw / a
        w = np.sign(w) * np.maximum(np.abs(w) - pace * l1, 0)
        move = 0.05 * (mt / a) / (np.sqrt(vt / b) + 1e-4)
        first, gaps = first - move[0], gaps - move[1:]
    return w, first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_other: int = MAX_OTHER, n_grades: int = 4, l1: float = 2e-4) -> Model:
    """A model from labelled rows of ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic).

    The sample is of bounded size: of each class the documents with the smallest hashes of doc_id,
    one text of each (of rows that share a doc_id the least). Null labels and null texts are left
    out. Without both classes, nothing is toxic.
    """
    asked = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = asked.where("toxic = 1").orderBy(*order).limit(max_toxic).union(asked.where("toxic = 0").orderBy(*order).limit(max_other))
    texts = docs.where("text is not null").select("doc_id", "text")
    rows = stable(texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")))  # at most max_toxic + max_other rows
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    asked_of = {r["toxic"]: r["n"] for r in asked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    nothing = Model({}, tuple(50.0 + k for k in range(n_grades - 1)))
    if len(sizes) < 2:
        return nothing

    def kinds():
        return lambda text: (list(count_features(text)),)

    # The features that tell the classes apart best, by the log odds of rows with them over its error.
    found = per_text(kinds, "x array<string>", ["x"])(F.col("text"))["x"]
    each = rows.select("toxic", F.explode(found).alias("feature")).groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    a, b, c, d = (x + 0.5 for x in (F.col("a"), F.col("b"), sizes[1] - F.col("a"), sizes[0] - F.col("b")))
    z = F.abs(F.ln(a * d / (b * c))) / F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    best = each.where(F.col("a") + F.col("b") >= MIN_ROWS).orderBy(z.desc(), "feature").limit(MAX_FEATURES).select("feature")
    words = {r["feature"]: i for i, r in enumerate(sorted(best.collect()))}
    if not words:
        return nothing

    def counted():
        def one(text: str) -> tuple:
            n = count_features(text, words)
            return [words[x] for x in n], list(n.values())

        return one

    counts = per_text(counted, "i array<int>, n array<int>", ["i", "n"])(F.col("text"))
    got = rows.select("doc_id", "toxic", counts.alias("x")).select("doc_id", "toxic", "x.i", "x.n").toPandas().sort_values("doc_id", kind="stable")
    index = [np.array(x, np.int64) for x in got["i"]]
    value = [np.log1p(np.array(x, float)) for x in got["n"]]
    toxic = got["toxic"].to_numpy(int)
    # How many labels a row of the sample stands for: 1 for a class under its limit.
    stands_for = [max(1.0, asked_of[k] / most) for k, most in ((0, max_other), (1, max_toxic))]
    weight = np.array(stands_for)[toxic]
    w, _ = _fit(index, value, toxic, len(words), 2, l1, weight)
    eta = np.array([v @ w[i] for i, v in zip(index, value, strict=True)])
    severe = toxic.copy()
    own = np.flatnonzero(toxic)
    severe[own[np.argsort(eta[own], kind="stable")]] = 1 + np.arange(len(own)) * (n_grades - 1) // max(len(own), 1)
    w, theta = _fit(index, value, severe, len(words), n_grades, l1, weight)
    return Model({x: float(w[i]) for x, i in words.items() if w[i] != 0}, tuple(float(t) for t in theta))


def severity(text: Column, model: Model) -> Column:
    """Struct (expected_severity, p_toxic, words) of each text; null counts as empty."""
    return per_text(lambda: model.severity, "expected_severity double, p_toxic double, words array<string>", ["expected_severity", "p_toxic", "words"])(text)


def score(docs: DataFrame, model: Model, reject: float = 0.5) -> DataFrame:
    """doc_id, expected_severity, p_toxic, toxic (p_toxic >= reject) and words for every row.

    One narrow pass over whole texts. Null and empty texts score as a text without known words;
    repeated rows repeat; other columns are ignored.
    """
    x = docs.select("doc_id", severity(F.col("text"), model).alias("x"))
    return x.select("doc_id", "x.expected_severity", "x.p_toxic", (F.col("x.p_toxic") >= reject).alias("toxic"), F.col("x.words").alias("toxic_words"))
