"""Language identification by hyperdimensional profiles (Joshi, Halseth and Kanerva 2016).

Each letter has a random vector of +1 and -1, drawn from its code point. A 3-gram's vector is the
product of its letters' vectors, rotated by place; a text's is the sum of those of all its
3-grams, a language's the sum over its texts of these sums, each scaled to length one. A text
gets the language whose vector has the largest cosine with its own.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from elutra.llm.shared import per_text

DIM, SEED = 512, 17
#: For each language the fit takes at most so many texts, those with the smallest hashes of doc_id.
MAX_TEXTS = 1000
#: 3-grams whose vectors a task remembers at once.
MAX_GRAMS = 60_000


@lru_cache(maxsize=4096)
def letter(code: int, dim: int) -> np.ndarray:
    return np.random.default_rng([SEED, code]).integers(0, 2, dim, dtype=np.int8) * np.int8(2) - np.int8(1)


def letters_of(text: str) -> np.ndarray:
    """Code points in lower case, with every run of anything but letters made one blank."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    plain = (codes >= 97) & (codes <= 122)
    rest = np.flatnonzero(~plain & (codes > 127))
    if len(rest):
        kinds, at = np.unique(codes[rest], return_inverse=True)
        plain[rest] = np.array([chr(c).isalpha() for c in kinds.tolist()])[at]
    codes = np.where(plain, codes, 32)
    keep = plain.copy()
    keep[1:] |= plain[:-1]  # the first blank after a letter
    return codes[keep]


class Bundler:
    """Vectors of texts. Vectors of 3-grams are kept in one table, which starts anew when it is full."""

    def __init__(self, dim: int):
        self.dim = dim
        self.row: dict[int, int] = {}
        self.vectors = np.empty((1024, dim), np.float32)

    def _add(self, gram: int) -> int:
        a, b, c = gram >> 42, gram >> 21 & 0x1FFFFF, gram & 0x1FFFFF
        at = len(self.row)
        if at == len(self.vectors):
            self.vectors = np.resize(self.vectors, (min(2 * at, MAX_GRAMS), self.dim))
        self.vectors[at] = np.roll(letter(a, self.dim), 2) * np.roll(letter(b, self.dim), 1) * letter(c, self.dim)
        self.row[gram] = at
        return at

    def bundle(self, text: str) -> np.ndarray | None:
        """The text's vector; None if it has no letter."""
        codes = letters_of(text)
        if not len(codes):
            return None
        x = np.concatenate([[32], codes, [32, 32]]).astype(np.uint64)  # at least one 3-gram for each letter
        grams, n = np.unique(x[:-2] << np.uint64(42) | x[1:-1] << np.uint64(21) | x[2:], return_counts=True)
        total = np.zeros(self.dim, np.float64)
        for lo in range(0, len(grams), 4096):
            part = grams[lo : lo + 4096].tolist()
            if len(self.row) + len(part) > MAX_GRAMS:
                self.row.clear()
            get = self.row.get
            rows = [at if (at := get(g)) is not None else self._add(g) for g in part]
            total += n[lo : lo + 4096].astype(np.float32) @ self.vectors[rows]
        return total


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    prototypes: np.ndarray  # of length one, a row for each language

    def predictor(self):
        bundler = Bundler(self.prototypes.shape[1])

        def one(text: str) -> tuple[str, float]:
            v = bundler.bundle(text) if self.languages else None
            size = 0.0 if v is None else float(np.linalg.norm(v))
            if not size:
                return "und", 0.0
            cosines = self.prototypes @ v / size
            best = int(np.argmax(cosines))
            return self.languages[best], float(min(1.0, max(0.0, cosines[best])))

        return one


def fit(docs: DataFrame, max_texts: int = MAX_TEXTS, dim: int = DIM) -> Model:
    """Prototypes from rows of ``docs`` (doc_id, text, lang) with text and language.

    At most ``max_texts`` texts of each language, however many rows there are; each is read whole.
    Of rows that share doc_id and language the least text counts.
    """
    known = docs.where("doc_id is not null and text is not null and lang is not null")
    ids = known.select("doc_id", "lang").distinct().withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    # First the smallest within shares of a language, so that a frequent one is never sorted in one task.
    for by in (["lang", "salt"], ["lang"]):
        ids = ids.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= max_texts).drop("rank")
    rows = known.select("doc_id", "text", "lang").join(F.broadcast(ids.select("doc_id", "lang").distinct()), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))

    def make():
        bundler = Bundler(dim)

        def one(text: str) -> tuple:
            v = bundler.bundle(text)
            return (None,) if v is None else ((v / max(np.linalg.norm(v), 1e-12)).tolist(),)

        return one

    vector = per_text(make, "v array<double>", ["v"])(F.col("text"))
    sums = rows.select("lang", vector.alias("x")).select("lang", F.posexplode("x.v").alias("at", "value")).groupBy("lang", "at").agg(F.sum("value").alias("value"))
    got = sums.toPandas().pivot(index="lang", columns="at", values="value").sort_index()  # languages x dim
    if got.empty:
        return Model((), np.zeros((0, dim)))
    p = got.to_numpy(float)
    return Model(tuple(got.index), p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12))


def predict(text: Column, model: Model) -> Column:
    """Struct (lang_pred, score) of each text: "und" and 0 for null and for texts without a letter."""
    return per_text(model.predictor, "lang_pred string, score double", ["lang_pred", "score"])(text)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for every row of ``docs`` (doc_id, text), in one narrow pass.

    Equal cosines: the first language in order of name. Repeated rows repeat; other columns are ignored.
    """
    return docs.select("doc_id", predict(F.col("text"), model).alias("x")).select("doc_id", "x.lang_pred", "x.score")
