"""Near copies among embeddings of one label, by a forest of random-projection trees.

A tree splits the vectors of a label at the median of their projections on a random direction;
vectors close to the border go to both sides. Vectors that meet in a leaf of any tree are
compared. Borders come from a sample, in a task for each tree, and every vector is dealt through
the trees. Groups are joined from the links found; then every group's vectors are compared with
all others of the group, in blocks, which gives each one's number of links exactly for the group.

A pair linked at 0.93 parts at a border without spill with a chance of 0.12. With a spill of a
quarter of a linked pair's usual distance, six trees of seven levels find over 0.99 of such pairs
at 11 copies of each vector; a spill of the whole distance would take 75 copies for four trees.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from elutra.llm.components import components
from elutra.llm.shared import stable
from elutra.llm.simhash import Groups, in_blocks

TREES, LEAF, SPILL = 6, 1024, 0.25
#: Borders are made from at most so many vectors, those with the smallest hashes, down to leaves of LEAST of them.
MAX_SAMPLE, LEAST = 262_144, 16
#: Vectors of a leaf or group in one task; larger ones are compared block by block in several.
BLOCK = 4096

Borders = dict[int, float]  # by node of a tree: the root is 1, node k has the children 2k and 2k + 1; nodes without one are leaves


@lru_cache(maxsize=100_000)
def direction(seed: int, tree: int, node: int, dim: int) -> np.ndarray:
    x = np.random.default_rng([seed, tree, *divmod(node, 1 << 32)]).standard_normal(dim)
    return x / np.linalg.norm(x)


def grow(x: np.ndarray, seed: int, tree: int, most: int) -> Borders:
    """Borders of a tree over the rows of ``x`` with at most ``most`` of them in a leaf, where they can be told apart."""
    borders, todo = {}, [(1, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if len(rows) <= most:
            continue
        at = x[rows] @ direction(seed, tree, node, x.shape[1])
        border = float(np.median(at))
        left = at <= border
        if 0 < left.sum() < len(rows):
            borders[node] = border
            todo += [(2 * node, rows[left]), (2 * node + 1, rows[~left])]
    return borders


def deal(borders: Borders, x: np.ndarray, seed: int, tree: int, margin: float) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, rows of x) for all leaves that rows reach."""
    todo = [(1, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        border = borders.get(node)
        if border is None:
            yield node, rows
        elif len(rows):
            at = x[rows] @ direction(seed, tree, node, x.shape[1])
            todo += [(2 * node, rows[at <= border + margin]), (2 * node + 1, rows[at > border - margin])]


def unit(vectors: pd.Series) -> np.ndarray:
    x = np.array(vectors.tolist(), np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares of extreme values stay in range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def margin_of(threshold: float, dim: int) -> float:
    """A share of the usual distance of two linked unit vectors along a random direction."""
    return SPILL * float(np.sqrt(max(0.0, 2 - 2 * threshold) / max(1, dim)))


def seed_of(label: str, seed: int) -> int:
    return zlib.crc32(label.encode()) ^ seed


def usable(vector: Column) -> Column:
    """Whether a vector can link: not null or empty, all components finite, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def links(nodes: DataFrame, threshold: float, trees: int = TREES, leaf: int = LEAF, sample: int = MAX_SAMPLE, seed: int = 3) -> DataFrame:
    """Links (a, b) that join the distinct vectors ``nodes`` (node, label, embedding) to groups.

    A label of up to ``leaf`` vectors is one leaf of one tree.
    """
    kind = nodes.schema["embedding"].dataType.simpleString()
    n = nodes.count()
    share = max(1.0, n / sample)
    picked = nodes.select("node", "label", "embedding", F.size("embedding").alias("dim"))
    picked = picked.where(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < int((1 << 30) / share))
    picked = picked.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    most = max(LEAST, int(leaf / share))

    def borders_of(key, frame: pd.DataFrame) -> pd.DataFrame:
        label, dim, tree = key
        x = unit(frame.sort_values("node")["embedding"])
        found = grow(x, seed_of(label, seed), tree, most)
        return pd.DataFrame({"label": label, "dim": dim, "tree": tree, "node": list(found), "border": list(found.values())})

    forests: dict[tuple[str, int], dict[int, Borders]] = {}
    grown = picked.groupBy("label", "dim", "tree").applyInPandas(borders_of, "label string, dim int, tree int, node long, border double")
    for r in grown.collect():  # a border for every LEAST vectors of the sample, at most
        forests.setdefault((r["label"], r["dim"]), {}).setdefault(r["tree"], {})[r["node"]] = r["border"]
    shared = nodes.sparkSession.sparkContext.broadcast(forests)

    def visits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            dims = frame["embedding"].map(len).to_numpy()
            found = [(np.zeros(0, np.int64), 0, 0)]
            for (label, dim), own in frame.groupby(["label", dims]).indices.items():
                x = unit(frame["embedding"].iloc[own])
                for tree, borders in shared.value.get((label, dim), {0: {}}).items():
                    found += [(own[rows], tree, number) for number, rows in deal(borders, x, seed_of(label, seed), tree, margin_of(threshold, dim))]
            rows = np.concatenate([r for r, _, _ in found])
            tree, leaf_of = (np.repeat(np.array([f[k] for f in found], np.int64), [len(f[0]) for f in found]) for k in (1, 2))
            yield frame.iloc[rows].assign(dim=dims[rows].astype(np.int32), tree=tree.astype(np.int32), leaf=leaf_of)

    spread = nodes.select("node", "label", "embedding").mapInPandas(visits, f"node long, label string, embedding {kind}, dim int, tree int, leaf long")

    def within(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates("node").sort_values("node")
        x, node = unit(frame["embedding"]), frame["node"].to_numpy()
        groups = Groups(len(x))
        for lo in range(0, len(x), 512):
            q, h = np.nonzero(x[lo : lo + 512] @ x.T >= threshold)
            own = q + lo != h
            q, h = q[own], h[own]
            for part in np.split(np.arange(len(q)), np.flatnonzero(np.diff(q)) + 1) if len(q) else ():
                groups.join(int(q[part[0]]) + lo, h[part])
        found = np.array(groups.links, np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": node[found[:, 0]], "b": node[found[:, 1]]})

    return in_blocks(spread, ["label", "dim", "tree", "leaf"], BLOCK).applyInPandas(within, "a long, b long")


def count_links(members: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(node, n_links) over the vectors of each group ``members`` (component, size, node, copies, embedding).

    A group is cut into chunks; each of its vectors is compared with every chunk.
    """
    chunks = F.ceil(F.col("size") / block).cast("int")
    homes = members.withColumn("chunk", F.pmod(F.xxhash64("node"), chunks).cast("int")).withColumn("home", F.lit(True))
    asking = members.withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1))).withColumn("home", F.lit(False))

    def within(key, frame: pd.DataFrame) -> pd.DataFrame:
        home = frame["home"].to_numpy(bool)
        x, node, copies = unit(frame["embedding"]), frame["node"].to_numpy(), frame["copies"].to_numpy()
        q, h = np.flatnonzero(~home), np.flatnonzero(home)
        n = np.zeros(len(q), np.int64)
        for lo in range(0, len(q), 512):
            own = q[lo : lo + 512]
            near = (x[own] @ x[h].T >= threshold) & (node[own][:, None] != node[h][None, :])
            n[lo : lo + 512] = near @ copies[h]
        return pd.DataFrame({"node": node[q], "n": n})

    columns = ["component", "chunk", "home", "node", "copies", "embedding"]
    each = homes.select(columns).union(asking.select(columns)).groupBy("component", "chunk").applyInPandas(within, "node long, n long")
    return each.groupBy("node").agg(F.sum("n").alias("n_links"))


def group(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``vectors`` (vec_id, embedding, label).

    Vectors link if their labels, of any type, are equal and their cosine, in double precision, is at
    least ``threshold``. Rows with a null label, vec_id or vector, with a vector that is zero, empty or
    holds null or non-finite components, and vectors of another length than all others of their
    label, link with nothing and stay. Equal vectors are one node: a group of copies costs one
    row in the search, and its links count by the number of copies. An empty table stays empty.
    """
    may = usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = vectors.select("vec_id", F.col("label").cast("string").alias("label"), "embedding", may.alias("may"))
    good = rows.where("may").select("vec_id", "label", "embedding")
    nodes = stable(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")))
    found = stable(components(links(nodes, threshold)))
    sizes = found.groupBy("component").agg(F.count("*").alias("size"))
    members = found.join(sizes, "component").join(nodes, "node")
    counted = count_links(members, threshold)
    known = nodes.join(found, "node", "left").join(counted, "node", "left").select("label", "embedding", F.coalesce("component", "node").alias("component_id"), (F.col("copies") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"))
    joined = good.join(stable(known), ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    rest = rows.where(~F.col("may")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
