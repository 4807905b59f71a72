"""Benchmark decontamination by greedy string tiling with running Karp-Rabin hashes (Wise 1993).

A test item and a document share tiles: runs of equal tokens, each token in one tile at most, the
longest marked first. What share of an item's tokens the tiles cover does not depend on their
order in the document, so reordered passages count as well.

Seeds are hashes of ``min_tile`` tokens. Those of documents that a bitmap of fixed size knows from
the items are joined with the items' seeds, which gives, for each document and item, the most that
tiles can cover; the few pairs for which this is enough are then tiled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from elutra.llm.shared import per_text, small_side, stable

TOKENS = re.compile(r"\w+")
BASE = 0x9E3779B97F4A7C15
MIN_TILE, COVERAGE = 5, 0.5
#: Bits of the map of the items' seeds, whatever their number.
BITS = 1 << 26
MATCH = "item_id long, coverage double, tiles array<struct<item_start:int,doc_start:int,length:int>>"


class _Hashes(dict):
    """Hashes of words, remembered for some."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 300_000:
            self.clear()
        self[word] = got = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))
        return got


def reader():
    """A function that gives the hashes of a text's tokens."""
    known = _Hashes()

    def tokens(text: str) -> np.ndarray:
        words = TOKENS.findall(text.lower())
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    return tokens


class Running:
    """Karp-Rabin hashes of all runs of a text's tokens, of any length, from sums that are made once."""

    _powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]  # of the base and of its inverse

    def __init__(self, tokens: np.ndarray):
        up, down = self._powers
        if len(up) <= len(tokens):
            inverse = pow(BASE, -1, 1 << 64)
            for k, base in enumerate((BASE, inverse)):
                self._powers[k] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * len(tokens), base, np.uint64)]))
            up, down = self._powers
        self.down = down
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tokens * up[: len(tokens)])])

    def of(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return (self.sums[width:] - self.sums[:n]) * self.down[:n] if n > 0 else np.zeros(0, np.uint64)


def tiles(item: np.ndarray, doc: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """(start in item, start in doc, length) of the greedy tiles of at least ``width`` tokens.

    The greatest length at which unmarked runs match is found by halving; all tiles of that length
    are marked, of equal ones the first in the item, then in the document. Pairs of places are never
    listed, so repeated tokens cost no more than others.
    """
    runs = (Running(item), Running(doc))
    free = (np.ones(len(item), bool), np.ones(len(doc), bool))

    def open_runs(length: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Places and hashes of runs without a marked token. Tiles marked so far are as long at least, so they hold an end of a run they meet."""
        found = []
        for run, own in zip(runs, free, strict=True):
            h = run.of(length)
            at = np.flatnonzero(own[: len(h)] & own[length - 1 : length - 1 + len(h)])
            found.append((at, h[at]))
        return found

    def any_at(length: int) -> bool:
        (_, x), (_, y) = open_runs(length)
        return bool(np.isin(x, y).any())

    found, most = [], min(len(item), len(doc))
    while most >= width and any_at(width):
        low, high = width, most
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if any_at(middle) else (low, middle - 1)
        (at, x), (to, y) = open_runs(low)
        order = np.argsort(y, kind="stable")
        to, y = to[order], y[order]
        first, end = np.searchsorted(y, x, "left"), np.searchsorted(y, x, "right")
        next_of: dict[int, int] = {}
        for i, a, b in zip(at.tolist(), first.tolist(), end.tolist(), strict=True):
            if a == b or not (free[0][i] and free[0][i + low - 1]):
                continue
            k = next_of.get(a, a)
            while k < b and not (free[1][to[k]] and free[1][to[k] + low - 1]):
                k += 1
            next_of[a] = k
            if k < b and (item[i : i + low] == doc[to[k] : to[k] + low]).all():
                j = int(to[k])
                free[0][i : i + low] = free[1][j : j + low] = False
                found.append((i, j, low))
        most = low - 1
    return found


def _items(benchmark: DataFrame, min_tile: int) -> DataFrame:
    """(item, item_id, tokens, width, seeds) of the test items with tokens; repeated rows once."""

    def make():
        tokens = reader()

        def one(text: str) -> tuple:
            own = tokens(text)
            width = min(min_tile, len(own))
            return own.view(np.int64), width, Running(own).of(width).view(np.int64) if width else np.zeros(0, np.int64)

        return one

    rows = benchmark.where("text is not null").select("item_id", "text").distinct()
    read = per_text(make, "tokens array<long>, width int, seeds array<long>", ["tokens", "width", "seeds"])(F.col("text"))
    return stable(rows.select(_key("item_id").alias("item"), "item_id", read.alias("x")).select("item", "item_id", "x.*").where("width > 0"))


def _key(id_column: str) -> Column:
    """A hash of id and text: rows that share both are decided alike."""
    return F.xxhash64(F.coalesce(F.col(id_column).cast("string"), F.lit("")), F.col("text"))


def _bitmap(seeds: DataFrame) -> np.ndarray:
    """BITS bits, in which those of the seeds are set."""
    at = F.pmod("seed", F.lit(BITS)) + 1
    rows = seeds.groupBy(F.bitmap_bucket_number(at).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()  # 8 MB at most
    bits = np.zeros(BITS // 8, np.uint8)
    for k, own in rows:
        bits[(k - 1) * len(own) : k * len(own)] = np.frombuffer(own, np.uint8)
    return bits


def _found(docs: DataFrame, benchmark: DataFrame, min_tile: int, coverage: float) -> tuple[DataFrame, DataFrame]:
    """(key, doc_id) of the rows that share a seed with an item, and (key, item_id, coverage, tiles) of those that contain one."""
    items = _items(benchmark, min_tile)
    seeds = items.select("item", "width", F.size("tokens").alias("n"), F.posexplode("seeds").alias("i", "seed"))
    widths = sorted(r["width"] for r in items.select("width").distinct().collect())  # min_tile at most
    shared = docs.sparkSession.sparkContext.broadcast((_bitmap(seeds), widths))

    def make():
        bits, own_widths = shared.value
        tokens = reader()

        def one(text: str) -> tuple:
            run = Running(tokens(text))
            own = np.concatenate([run.of(w) for w in own_widths] or [np.zeros(0, np.uint64)])
            at = (own & np.uint64(BITS - 1)).astype(np.int64)
            return (np.unique(own[bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1].view(np.int64)),)

        return one

    asked = per_text(make, "seeds array<long>", ["seeds"])(F.col("text"))["seeds"]
    of_docs = docs.where("text is not null").select(_key("doc_id").alias("key"), "doc_id", "text", asked.alias("seeds"))
    of_docs = stable(of_docs.where(F.size("seeds") > 0))
    rows = of_docs.dropDuplicates(["key"])
    hits = rows.select("key", F.explode("seeds").alias("seed")).join(seeds, "seed")
    places = hits.groupBy("key", "item").agg(F.collect_set("i").alias("i"), F.first("width").alias("width"), F.first("n").alias("n"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("i", lambda i: F.sequence(i, i + F.col("width") - 1)))))
    pairs = places.where(covered >= coverage * F.col("n")).select("key", "item")

    def run(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        tokens = reader()
        for texts, items_of, widths_of in parts:
            out = []
            for text, item, width in zip(texts, items_of, widths_of, strict=True):
                item = np.array(item, np.int64).view(np.uint64)
                got = sorted(tiles(item, tokens(text), int(width)))
                out.append((sum(n for _, _, n in got) / len(item), [{"item_start": i, "doc_start": j, "length": n} for i, j, n in got]))
            yield pd.DataFrame(out, columns=["coverage", "tiles"])

    run.__annotations__ = {"parts": Iterator[tuple[pd.Series, pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
    tiled = F.pandas_udf(run, MATCH.removeprefix("item_id long, ")).asNondeterministic()
    both = pairs.join(items.select("item", "item_id", "tokens", "width"), "item").join(rows.select("key", "text"), "key")
    found = both.select("key", "item_id", tiled("text", "tokens", "width").alias("x")).select("key", "item_id", "x.*").where(F.col("coverage") >= coverage)
    return of_docs.select("key", "doc_id"), stable(found)


def leaks(docs: DataFrame, benchmark: DataFrame, min_tile: int = MIN_TILE, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, coverage, tiles) of every document that contains a test item.

    Whole texts are read once, whatever the number of items. Items shorter than ``min_tile`` tokens
    must be there whole; items without tokens match nothing, and those without an id count like
    others. Repeated documents repeat, repeated items count once; rows without doc_id count like
    others, null and empty texts contain nothing, other columns are ignored. With an empty
    benchmark the result is empty.
    """
    rows, found = _found(docs, benchmark, min_tile, coverage)
    return rows.join(found, "key").select("doc_id", "item_id", "coverage", "tiles")


def clean(docs: DataFrame, benchmark: DataFrame, min_tile: int = MIN_TILE, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs``, with all their columns, that contain no test item; see ``leaks``."""
    _, found = _found(docs, benchmark, min_tile, coverage)
    bad = small_side(found.select(F.col("key").alias("leaking_key")).distinct())
    return docs.join(bad, F.coalesce(_key("doc_id"), F.lit(0)) == bad["leaking_key"], "left_anti")
