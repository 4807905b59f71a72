"""The near-copy stage against brute-force Jaccard similarities."""

from __future__ import annotations

import random

import numpy as np
import pytest

from elutra.llm import near_copies


def shingle_set(text: str | None) -> frozenset:
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows) -> dict:
    sets = [shingle_set(t) for _, t in rows]
    of = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                old, new = of[i], of[j]
                of = [new if c == old else c for c in of]
    first = {}
    for (d, _), c in zip(rows, of, strict=True):
        first[c] = min(first.get(c, d), d)
    return {d: first[c] for (d, _), c in zip(rows, of, strict=True)}


def made(rng) -> list:
    """Texts with one edited block or scattered edits, around a similarity of 0.8; chains, a common line, a large group."""
    line = " ".join("line%d" % i for i in range(12))
    texts = []
    for _ in range(60):
        words = ["w%d" % rng.randrange(3000) for _ in range(rng.randrange(60, 250))]
        texts.append(" ".join(words) + " " + line)
        for _ in range(rng.randrange(1, 4)):
            if rng.random() < 0.5:
                k = int(len(words) * rng.uniform(0.02, 0.2))
                at = rng.randrange(len(words) - k)
                words = words[:at] + ["x%d" % rng.randrange(3000) for _ in range(k)] + words[at + k :]
            else:
                words = [("y%d" % rng.randrange(3000) if rng.random() < 0.03 else w) for w in words]
            texts.append(" ".join(words) + " " + line)
    base = ["g%d" % i for i in range(120)]
    for _ in range(60):
        own = list(base)
        for at in rng.sample(range(120), 3):
            own[at] = "h%d" % rng.randrange(9999)
        texts.append(" ".join(own))
    texts += ["", " ", None, "a b", "A  b", "a b c", "a b c d e f g h", "a b c d e f g h i", line, line.upper()]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_bins_never_rule_out_similar_sets():
    """The bound holds for any two sets; it equals the size for a set with itself, and parts most sets that share little."""
    rng, apart, pairs = np.random.default_rng(3), 0, 0
    for _ in range(3000):
        n = int(rng.integers(1, 900))
        x = np.unique(rng.integers(-(1 << 63), 1 << 63, n))
        y = np.unique(np.concatenate([x[: int(rng.integers(0, n + 1))], rng.integers(-(1 << 63), 1 << 63, int(rng.integers(0, n + 1)))]))
        if not len(y):
            continue
        shared, most = len(np.intersect1d(x, y)), near_copies._most_shared(near_copies._bins(x), near_copies._bins(y))
        assert shared <= most <= 2 * max(len(x), len(y))
        assert near_copies._most_shared(near_copies._bins(x), near_copies._bins(x)) == len(x)
        if n > 50 and 0.8 < len(x) / len(y) < 1.25 and shared < 0.3 * len(x):
            pairs, apart = pairs + 1, apart + (9 * most < 4 * (len(x) + len(y)))
    assert pairs > 30 and apart > 0.9 * pairs
    assert near_copies._bins(np.zeros(300, np.int64)) == b""  # a count beyond a byte: no bound


def test_short_similar_texts_are_all_found(spark):
    """Sets of four and five shingles, four in common: fingerprints say next to nothing of them."""
    rows = []
    for k in range(2000):
        words = [f"a{k}w{i}" for i in range(9)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:8]))]
    got = near_copies.group(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted(tuple(r) for r in got) == [(d, d - d % 2) for d in range(4000)]


@pytest.mark.parametrize("often", [4, 1 << 30])
def test_groups_are_those_of_brute_force(spark, monkeypatch, often):
    monkeypatch.setattr(near_copies, "OFTEN", often)
    rows = made(random.Random(7))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in near_copies.group(df).collect()}
    assert got == brute(rows)
    assert near_copies.group(df.limit(0)).count() == 0


def test_a_group_of_near_copies_does_not_cost_its_square(spark, monkeypatch):
    """Copies of one text with up to three edits each, of which the trees find nothing: most pairs are similar, few are compared."""
    rng, rows = random.Random(11), []
    for d in range(300):
        words = [f"base{i}" for i in range(150)]
        for at in rng.sample(range(150), d % 4):
            words[at] = f"own{d}at{at}"
        rows.append((d, " ".join(words)))
    compared, verified = [], near_copies._verified
    monkeypatch.setattr(near_copies, "RULE", near_copies.simhash.Rule(reach=0, trees=4))
    monkeypatch.setattr(near_copies, "_verified", lambda pairs, sets: compared.append(pairs.count()) or verified(pairs, sets))
    got = {r["doc_id"]: r["component_id"] for r in near_copies.group(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
    assert sum(compared) < 5 * len(rows)


def test_keep_one_is_exact_on_the_documents(spark):
    """These documents have pairs of similarities down to 0.64 that fingerprints link."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in df.collect()])
    assert {r["doc_id"] for r in near_copies.keep_one(df).collect()} == {d for d, c in want.items() if d == c}


def test_pipeline_keeps_what_is_below_the_similarity(spark):
    """The run against its stages, with the near copies of brute force."""
    import corpus_pipeline
    from elutra.llm import decontam, quality, toxicity

    sf = "/root/testdata/sf0.001"
    docs, labels, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, sf).select("doc_id").collect()}
    model = toxicity.fit(docs, labels)
    rest = spark.createDataFrame([r for r in docs.collect() if model.severity(r["text"] or "")[1] < 0.5], docs.schema)
    good = {r["doc_id"] for r in quality.score(rest, quality.fit(rest, labels)).where("predicted = 1").collect()}
    left = [(r["doc_id"], r["text"]) for r in rest.collect() if r["doc_id"] in good]
    of = brute(left)
    bench_docs = spark.createDataFrame([(d, t) for d, t in left if of[d] == d], "doc_id long, text string")
    leaking = {r["doc_id"] for r in decontam.leaks(bench_docs, bench).select("doc_id").collect()}
    assert got == {d for d, _ in left if of[d] == d and d not in leaking}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_dedup", "decontamination", "bpe"]
