"""SimHash fingerprints and their near-duplicate groups, found with vantage-point trees.

The bits are cut into parts, each with a tree: of two fingerprints within ``reach`` bits one part
differs in at most reach // trees, so each tree searches that closely. For the usual reach of 3 and
four trees this is 0: a fingerprint then visits one shard of each tree, for any number of shards.

The upper levels of a tree measure Hamming distance from vantage points on bits of its part and deal
fingerprints to shards; each is at home in one, and asks the other shards whose border is close
enough: as the bits of the levels don't overlap, the triangle bounds of the levels add up, and a
search takes with it how many differing bits are left. Within a shard the tree goes on, over the
rest of the part's bits and then over whole fingerprints, with median radii.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from elutra.llm.components import components
from elutra.llm.shared import per_text, stable


def blocks_of(tree: int, trees: int) -> list[int]:
    """Masks of the blocks that a tree of ``trees`` uses: of three bits for one tree, else single bits."""
    size, own = (3, 64) if trees == 1 else (1, 64 // trees)
    return [((1 << size) - 1) << (tree * own + size * k) for k in range(own // size)]


#: The upper tree is made from at most so many fingerprints, those with the smallest hashes.
MAX_SAMPLE = 8192
#: Fingerprints of a shard, on average. Shards of over ``LARGE`` rows are compared in blocks, each pair of blocks in a task of its own.
SHARD, LARGE = 32_768, 200_000


def fingerprint_of(text: str, width: int = 3) -> int:
    words = text.encode("utf-8", "replace").lower().split()  # ASCII letters and white space only
    if not words:
        return 0
    shingles = map(b" ".join, zip(*[words[i:] for i in range(width)])) if len(words) >= width else [b" ".join(words)]
    ones, n = np.zeros(64, np.int64), 0
    digest, batch = xxhash.xxh64_intdigest, []
    for shingle in shingles:
        batch.append(digest(shingle, 42))
        if len(batch) == 8192:
            ones += _ones(batch)
            n += len(batch)
            batch = []
    if batch:
        ones += _ones(batch)
        n += len(batch)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _ones(hashes: list[int]) -> np.ndarray:
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.uint32)


def fingerprint(text: Column, width: int = 3) -> Column:
    """64-bit fingerprints as longs; 0 for null and for texts without words."""
    return per_text(lambda: lambda value: (int(np.uint64(fingerprint_of(value, width)).astype(np.int64)),), "fp long", ["fp"])(text)["fp"]


def build_tree(sample: np.ndarray, blocks: list[int], depth: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Vantage points and radii of a full binary tree; node k has the children 2k + 1 and 2k + 2.

    A fingerprint goes left if it differs in at most ``radius`` bits of the level's block.
    """
    rng = np.random.default_rng(seed)
    points, radii = np.zeros(2**depth - 1, np.uint64), np.zeros(2**depth - 1, np.int64)
    node = np.zeros(len(sample), np.int64)
    for level in range(depth):
        for k in range(2**level - 1, 2 ** (level + 1) - 1):
            own = sample[node == k]
            if len(own):
                points[k] = own[rng.integers(len(own))]
                radii[k] = _radius(_block(own, points[k], blocks[level]), blocks[level])
        left = _block(sample, points[node], blocks[level]) <= radii[node]
        node = 2 * node + np.where(left, 1, 2)
    return points, radii


def _radius(distances: np.ndarray, block: int) -> int:
    """The median, or less if nothing would lie beyond it."""
    return min(block.bit_count() - 1, int(np.median(distances)), max(0, int(distances.max()) - 1))


def _block(x: np.ndarray, point: np.ndarray, block: int) -> np.ndarray:
    return np.bitwise_count((x ^ point) & np.uint64(block)).astype(np.int64)


def route(x: np.ndarray, blocks: list[int], points: np.ndarray, radii: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position in x, shard, bits left) of every visit; at home a fingerprint has one bit more than ``reach``.

    Of two shards that could each ask the other only the one with the smaller number asks.
    """
    depth = (len(points) + 1).bit_length() - 1
    at, node, left_over, home = np.arange(len(x)), np.zeros(len(x), np.int64), np.full(len(x), reach), np.ones(len(x), bool)
    for level in range(depth):
        d, r = _block(x[at], points[node], blocks[level]), radii[node]
        inside = d <= r
        cost = np.where(inside, r + 1 - d, d - r)
        other = np.flatnonzero(left_over >= cost)
        child = 2 * node + np.where(inside, 1, 2)
        far = 2 * node[other] + np.where(inside[other], 2, 1)
        at, node = np.concatenate([at, at[other]]), np.concatenate([child, far])
        left_over, home = np.concatenate([left_over, left_over[other] - cost[other]]), np.concatenate([home, np.zeros(len(other), bool)])
    own = np.zeros(len(x), np.int64)
    own[at[home]] = node[home]
    keep = home | (node > own[at])
    return at[keep], node[keep], np.where(home, reach + 1, left_over)[keep]


class Groups:
    """Groups of positions, and the links that first joined them."""

    def __init__(self, n: int):
        self.parent = list(range(n))
        self.label = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, others: np.ndarray) -> None:
        labels, first = np.unique(self.label[others], return_index=True)
        mine = self.root(x)
        for label, k in zip(labels.tolist(), first.tolist(), strict=True):
            theirs = self.root(label)
            if theirs != mine:
                self.links.append((x, int(others[k])))
                self.parent[max(mine, theirs)] = min(mine, theirs)
                mine = min(mine, theirs)
        self.label[others] = mine
        self.label[x] = mine


@dataclass(frozen=True)
class Rule:
    """Fingerprints link within ``reach`` bits. Each of ``trees`` searches its part of the bits for up to ``near``
    differing ones; by default that is reach // trees, which finds all links."""

    width: int = 3
    reach: int = 3
    trees: int = 4
    near: int | None = None

    @property
    def part_reach(self) -> int:
        return self.reach // self.trees if self.near is None else self.near


def search(x: np.ndarray, reach: int, near: int, blocks: list[int], homes: np.ndarray, queries: np.ndarray, left_over: np.ndarray, level: int, groups: Groups) -> None:
    """Joins every query with the homes within ``reach`` of it, by a tree over the homes: bits of the part first, then whole fingerprints."""
    if not len(homes) or not len(queries):
        return
    if len(homes) <= 32 or len(homes) * len(queries) <= 1 << 15:
        _compare(x, reach, homes, queries, groups)
        return
    whole = level >= len(blocks)
    block = ~0 & (1 << 64) - 1 if whole else blocks[level]
    point = x[homes[len(homes) // 2]]
    d, dq = _block(x[homes], point, block), _block(x[queries], point, block)
    r = _radius(d, block)
    if r < 0 or r >= d.max():
        if not whole:
            search(x, reach, near, blocks, homes, queries, left_over, level + 1, groups)
        else:  # all equally far from the vantage point
            _compare(x, reach, homes, queries, groups)
        return
    for own, cost in ((d <= r, np.maximum(0, dq - r)), (d > r, np.maximum(0, r + 1 - dq))):
        go = cost <= (reach if whole else left_over)
        left = left_over[go] if whole else (left_over - cost)[go]
        search(x, reach, near, blocks, homes[own], queries[go], left, level + 1, groups)


def _compare(x: np.ndarray, reach: int, homes: np.ndarray, queries: np.ndarray, groups: Groups) -> None:
    step = max(1, (1 << 20) // len(homes))
    for lo in range(0, len(queries), step):
        own = queries[lo : lo + step]
        q, h = np.nonzero(np.bitwise_count(x[own][:, None] ^ x[homes][None, :]) <= reach)
        other = own[q] != homes[h]
        q, h = q[other], h[other]
        if len(q):
            for part in np.split(np.arange(len(q)), np.flatnonzero(np.diff(q)) + 1):
                groups.join(int(own[q[part[0]]]), homes[h[part]])


def depth_of(n: int, shard: int, rule: Rule) -> int:
    """Levels of the upper trees; a part has as many as it has blocks."""
    return min(len(blocks_of(0, rule.trees)), max(0, int(np.ceil(np.log2(max(1, n) / shard)))))


def links(nodes: DataFrame, n: int, rule: Rule, shard: int = SHARD, sample: int = MAX_SAMPLE, large: int = LARGE) -> DataFrame:
    """Links (a, b) that join the ``nodes`` (node, fp) to the same groups as all links do. No pairs are emitted
    beyond those that first join two groups within a shard."""
    picked = np.array([r["fp"] for r in nodes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()], np.int64).view(np.uint64)
    depth, near = depth_of(n, shard, rule), rule.part_reach
    all_blocks = [blocks_of(t, rule.trees) for t in range(rule.trees)]
    upper = [build_tree(picked, blocks, depth) for blocks in all_blocks]

    def visits(frames):
        for frame in frames:
            x = frame["fp"].to_numpy(np.int64).view(np.uint64)
            for t, (points, radii) in enumerate(upper):
                at, place, left_over = route(x, all_blocks[t], points, radii, near)
                yield frame.iloc[at].assign(tree=np.int32(t), shard=place, left_over=left_over.astype(np.int32))

    def within(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["fp", "node"])
        x, chunk = frame["fp"].to_numpy(np.int64).view(np.uint64), frame["chunk"].to_numpy()
        left_over, node = frame["left_over"].to_numpy(), frame["node"].to_numpy(np.int64)
        groups = Groups(len(x))
        home = left_over > near
        # Of the two chunks of a block one has the homes and the other one asks, and the other way round.
        for here in np.unique(chunk):
            asks = np.ones(len(x), bool) if len(np.unique(chunk)) == 1 else chunk != here
            search(x, rule.reach, near, all_blocks[key[0]], np.flatnonzero(home & (chunk == here)), np.flatnonzero(asks), np.minimum(left_over, near)[asks], depth, groups)
        found = np.array(groups.links, np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": node[found[:, 0]], "b": node[found[:, 1]]})

    spread = nodes.select("node", "fp").mapInPandas(visits, "node long, fp long, tree int, shard long, left_over int")
    return in_blocks(spread, ["tree", "shard"], large).applyInPandas(within, "a long, b long")


def in_blocks(spread: DataFrame, place: list[str], most: int) -> GroupedData:
    """Rows of ``spread`` (node, ...) grouped by ``place``. Those of a place with over ``most`` rows go to blocks:
    every two chunks of it meet in one, so the work of a hot place is dealt out as well. Adds chunk and block."""
    large = stable(spread.groupBy(*place).count().where(F.col("count") > most))
    if large.isEmpty():
        spread = spread.withColumns({"chunk": F.lit(0), "block": F.lit(0).cast("long")})
    else:
        chunks = F.ceil(F.col("count") * 2 / most).cast("int")
        spread = spread.join(large, place, "left").withColumn("chunks", F.coalesce(chunks, F.lit(1)))
        spread = spread.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
        spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        spread = spread.withColumn("block", F.least("chunk", "other").cast("long") * F.col("chunks") + F.greatest("chunk", "other"))
    return spread.groupBy(*place, "block")


def group(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, fp (long) and component_id for every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id that can be reached over the rule's links. Rows of equal
    fingerprints are one node, so a group of copies costs one row in the search. Null and empty
    texts have fingerprint 0, linked like any other. A null doc_id gets its group's smallest
    doc_id, or null in a group without any. Repeated rows repeat; other columns are ignored. An
    empty table stays empty.
    """
    of_docs = stable(docs.select("doc_id", fingerprint(F.col("text"), rule.width).alias("fp")))
    nodes = stable(of_docs.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = components(links(nodes.select(F.col("fp").alias("node"), "fp"), nodes.count(), rule))
    small = found.join(nodes, found["node"] == nodes["fp"]).groupBy("component").agg(F.min("first").alias("component_id"))
    of_node = found.join(small, "component").select(F.col("node").alias("fp"), "component_id")
    known = stable(nodes.join(of_node, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id")))
    return of_docs.join(known, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
