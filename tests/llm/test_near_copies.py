"""Near-duplicate operators and the pipeline against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from elutra.llm import embed_dedup, near_copies, simhash
from elutra.llm.components import components


def groups(n: int, links) -> list[int]:
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)] + [(500, 500)]
    want = groups(501, links)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: want[i] for i in {x for a, b in links if a != b for x in (a, b)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_fingerprint(text: str) -> int:
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\x0b", " ").replace("\x0c", " ").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if w]
    s = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


@pytest.mark.parametrize("text", ["", " ", "One", "a b", "A b c  d\te", "x y z " * 9000])
def test_fingerprint(text):
    assert simhash.fingerprint_of(text) == brute_fingerprint(text)


@pytest.mark.parametrize("rule,shard", [(simhash.Rule(), 1 << 20), (simhash.Rule(), 10), (simhash.Rule(trees=1), 100), (simhash.Rule(reach=10, trees=3), 200), (simhash.Rule(reach=8, trees=4), 1 << 20)])
@pytest.mark.parametrize("large", [simhash.LARGE, 40])
def test_links_join_what_brute_force_joins(spark, rule, shard, large):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    near = x[:300] ^ np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(1, rule.reach + 3), replace=False)) for _ in range(300)], np.uint64)
    x = np.unique(np.concatenate([x, near]))
    at = np.argwhere(np.bitwise_count(x[:, None] ^ x[None, :]) <= rule.reach)
    want = groups(len(x), at.tolist())
    nodes = spark.createDataFrame([(i, int(v)) for i, v in enumerate(x.view(np.int64))], "node long, fp long")
    found = [(r["a"], r["b"]) for r in simhash.links(nodes, len(x), rule, shard, 256, large).collect()]
    assert groups(len(x), found) == want


def test_a_fingerprint_visits_one_shard_of_each_tree():
    """Whatever the depth of the trees, and for a tree over all bits many more."""
    x = np.random.default_rng(8).integers(0, 1 << 63, 20_000, dtype=np.uint64)
    for depth in (1, 4, 8, 12):
        visits = 0
        for t in range(4):
            blocks = simhash.blocks_of(t, 4)
            at, shard, _ = simhash.route(x, blocks, *simhash.build_tree(x[:8000], blocks, depth), simhash.Rule().part_reach)
            visits += len(at)
            assert np.bincount(shard).max() < 4 * len(x) / 2**depth + 60
        assert visits == 4 * len(x)


def test_trees_over_whole_fingerprints_find_all_links():
    """Many fingerprints that share a part, so that only vantage points on all bits tell them apart."""
    rng = np.random.default_rng(9)
    x = rng.integers(0, 1 << 48, 3000, dtype=np.uint64)
    x = np.unique(np.concatenate([x, x[:900] ^ (np.uint64(1) << rng.integers(0, 48, 900, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 48, 900, dtype=np.uint64))]))
    own = simhash.Groups(len(x))
    everything = np.arange(len(x))
    simhash.search(x, 3, 0, simhash.blocks_of(3, 4), everything, everything, np.zeros(len(x), np.int64), 0, own)
    at = np.argwhere(np.bitwise_count(x[:, None] ^ x[None, :]) <= 3)
    assert groups(len(x), own.links) == groups(len(x), at.tolist())


def test_simhash_rows(spark):
    rows = [(5, "a b c d"), (3, "A B c d"), (9, None), (8, ""), (None, "a b c d"), (7, "other words here"), (7, "other words here")]
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, component_id string")
    got = sorted((r["doc_id"] or -1, r["component_id"]) for r in simhash.group(df).collect())
    assert got == [(-1, 3), (3, 3), (5, 3), (7, 7), (7, 7), (8, 8), (9, 8)]
    assert simhash.group(df.limit(0)).count() == 0


def test_keep_one(spark):
    rng = random.Random(4)
    words = ["w%d" % rng.randrange(900) for _ in range(200)]
    near = list(words)
    near[50] = "changed"
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(words)), (4, " ".join("v%d" % rng.randrange(900) for _ in range(200))), (4, "again"), (None, "x")]
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    kept = near_copies.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 4]


@pytest.mark.parametrize("block", [4096, 40])
def test_embeddings(spark, monkeypatch, block):
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    rng = np.random.default_rng(5)
    base = rng.standard_normal((150, 16))
    v = np.concatenate([base, base[:60] + 0.05 * rng.standard_normal((60, 16)), base[:5], 3 * base[5:8], base[:1] + 0.01 * rng.standard_normal((80, 16))]).astype(np.float32)
    rows = [(i, x.tolist(), int(i % 2)) for i, x in enumerate(v)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [1.0] * 15 + [float("nan")], 1), (903, [1.0] * 15 + [None], 1), (904, v[0].tolist(), None), (905, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.group(df).collect()}
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    near = (u @ u.T >= 0.93) & ((np.arange(len(v))[:, None] - np.arange(len(v))) % 2 == 0)
    want = groups(len(v), np.argwhere(near).tolist())
    assert {i: got[i] for i in range(len(v))} == {i: (int(near[i].sum()) - 1, want[i], want[i] == i) for i in range(len(v))}
    assert all(got[i] == (0, i, True) for i in range(900, 906))
    assert embed_dedup.group(df.limit(0)).count() == 0


def test_embedding_recall_with_many_leaves(spark, monkeypatch):
    """Pairs just over the threshold among vectors of one label, whose name is a text, in some hundred leaves of each tree."""
    monkeypatch.setattr(embed_dedup, "LEAF", 64)
    rng = np.random.default_rng(6)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x = unit(rng.standard_normal((8000, 64)))
    z = rng.standard_normal((1500, 64))
    z = unit(z - (z * x[:1500]).sum(1, keepdims=True) * x[:1500])
    c = rng.uniform(0.931, 0.97, (1500, 1))
    v = np.concatenate([x, c * x[:1500] + np.sqrt(1 - c * c) * z])
    nodes = spark.createDataFrame([(i, "one", y.tolist()) for i, y in enumerate(v)], "node long, label string, embedding array<double>")
    found = {tuple(sorted((r["a"], r["b"]))) for r in embed_dedup.links(nodes, 0.93, leaf=64).collect()}
    assert np.mean([(i, 8000 + i) in found for i in range(1500)]) > 0.95
    few = embed_dedup.links(nodes, 0.93, leaf=64, sample=2000)
    assert few.count() >= 0.9 * 1500
