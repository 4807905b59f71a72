"""Collocations against counts of all phrases, one by one."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from elutra.llm import phrases

SCHEMA = "doc_id long, text string, lang string"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least=30, longest=4, most=2000, cover=80):
    f, n = {}, Counter()
    for _, text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(UPPER)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.setdefault(lang, Counter()).update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        frequent = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = {p[i : i + k] for p, a in frequent.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= cover * counts[p[i : i + k]]}
        scored = []
        for p, a in frequent.items():
            if p not in gone:
                score, _, left, right = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, r, p.decode(), -a, left, right, n[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(scored)[:most], 1)]
    return sorted(out)


def sample(n, seed):
    draw, words = random.Random(seed), [f"w{k}" for k in range(60)] + ["Ab", "aB", "ünï", "日本", "x y"]
    fixed = ["the quick brown fox", "one two three four five", "of the", "a a a a a a"]
    rows = []
    for k in range(n):
        parts = [draw.choice(fixed) if draw.random() < 0.3 else words[min(int(draw.expovariate(0.15)), len(words) - 1)] for _ in range(draw.randrange(40))]
        rows.append((k, "".join(p + draw.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "!\r"]) for p in parts), draw.choice(["en", "de", None, "und"])))
    return rows + [(None, None, "en"), (1, "", None), (2, " \t\n", "fr"), (3, "the quick brown fox " * 400, "long"), (3, "the quick brown fox " * 400, "long")]


def told(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("chunk", [1 << 24, 900])
def test_equals_all_counts(spark, chunk, monkeypatch):
    """In one chunk a language, and in many."""
    docs = sample(700, 1)
    monkeypatch.setattr(phrases, "CHUNK", chunk)
    df = spark.createDataFrame(docs, SCHEMA).withColumnsRenamed({}).repartition(3)
    got = told(phrases.collocations(df.selectExpr("*", "1 AS row", "2 AS chunk", "'q' AS phrase")))
    assert got == brute(docs) and len(got) > 20


def test_limits(spark):
    docs = sample(250, 2)
    df = spark.createDataFrame(docs, SCHEMA)
    assert told(phrases.collocations(df, least=5, longest=3, most=7, cover=50)) == brute(docs, 5, 3, 7, 50)


def test_nothing_frequent(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, "once only", "en")], SCHEMA)).count() == 0


@pytest.mark.parametrize(("n", "top"), [(30_000, 40), (30_000, 100_000)])
def test_tiles_count_what_is_there(n, top):
    """Well filled tiles and sparse ones: counts and numbers of pairs."""
    rng = np.random.default_rng(3)
    ids = np.minimum(rng.zipf(1.3, n), top).astype(np.int64) - 2
    tiles, at = phrases.tiled(ids)
    edge = phrases.borders()
    width = np.diff(edge, append=1 << 40)
    of, counts = {}, Counter()
    for row, col, base, codes, found in tiles:
        codes = np.frombuffer(codes, phrases.code_type(int(width[row] * width[col]))).astype(np.int64)
        for k, (c, f) in enumerate(zip(codes.tolist(), np.frombuffer(found, np.uint32).tolist(), strict=True)):
            pair = (int(edge[row] + c // width[col]), int(edge[col] + c % width[col]))
            of[base + k], counts[pair] = pair, f
    want = Counter((int(a), int(b)) for a, b in zip(ids, ids[1:], strict=False) if a >= 0 and b >= 0)
    assert counts == want
    assert all((of[int(at[i])] == (ids[i], ids[i + 1])) if ids[i] >= 0 and ids[i + 1] >= 0 else at[i] == -1 for i in range(n - 1))


def test_sparse_sums_are_exact(monkeypatch):
    """Coordinates that are gathered and summed again and again."""
    monkeypatch.setattr(phrases, "GATHERED", 50)
    rng = np.random.default_rng(4)
    last = len(phrases.borders()) - 1
    row = next(k for k in range(last) if phrases.borders()[k] > 5000)
    for kind in (row, 3):
        sums, want = phrases.Sums(kind, kind), Counter()
        for _ in range(40):
            codes = np.unique(rng.integers(0, min(sums.area, 300), 30))
            counts = rng.integers(1, 9, len(codes)).astype(np.uint32)
            sums.add(codes.astype(phrases.code_type(sums.area)).tobytes(), counts.tobytes())
            want.update(dict(zip(codes.tolist(), counts.tolist(), strict=True)))
        a, b, f = sums.frequent(20)
        got = {int((x - sums.first[0]) * sums.width + (y - sums.first[1])): int(z) for x, y, z in zip(a, b, f, strict=True)}
        assert got == {c: k for c, k in want.items() if k >= 20}


def test_texts_are_cut_between_words():
    text = ("word " * 50 + "x" * 300 + " " + "tail\n" * 30).encode()
    for size in (7, 64, 10_000):
        assert b"".join(phrases.slices(text, size)) == text
        assert [w for part in phrases.slices(text, size) for w in phrases.tokens(part) if w] == [w for w in phrases.tokens(text) if w]
