"""Collocations of two to four words: counts by tiles of frequency-ranked ids, level by level.

Words that are frequent enough get ids in the order of their frequency. A pair of ids is a cell of a
matrix that is cut into tiles; tile borders lie closer together for frequent ids, so that tiles hold
comparable numbers of pairs. In a tile that is well filled, cells are addressed directly and counted by
``bincount``; in the others, cells are sorted and kept as coordinates. Frequent pairs get ids by their
frequency again, and two pairs that overlap in all but their ends are a pair of those ids: a phrase of
three words. Once more gives four.

The corpus is written as chunks of ids. Each chunk is sent only what became of its own words and pairs, so
nothing is broadcast, and what a task holds is a chunk, or the cells of one tile.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from elutra.llm.shared import shared_folder, stable
from elutra.operators.pairs import number

#: Bytes of text in a chunk.
CHUNK = 16 << 20
#: Tiles for each doubling of the id; and how many cells for each pair in it a tile may have to be addressed directly.
PARTS, DENSE = 2, 8
#: Cells that a task adds up directly; and coordinates that it gathers before it sums equal ones.
CELLS, GATHERED = 1 << 21, 1 << 21

BREAK = b"\xff"  # no byte of UTF-8
_FOLDED = bytes(x | 32 if 65 <= x <= 90 else 255 if x in b".,;:!?\n\x0b\x0c\r" else 32 if x == 9 else x for x in range(256))


def tokens(text: bytes) -> list[bytes]:
    """Words in order, with BREAK between pieces."""
    return text.translate(_FOLDED).replace(BREAK, b" \xff ").split(b" ")


def slices(text: bytes, size: int = 4 << 20) -> Iterator[bytes]:
    """A text in parts that end between words."""
    at = 0
    while len(text) - at > size:
        end = max(text.rfind(b" ", at, at + size), text.rfind(b"\n", at, at + size)) + 1
        end = end or at + size
        if end == at + size and text[end : end + 1] not in (b" ", b""):  # a word longer than a part
            end = next((k + 1 for k in range(end, len(text)) if text[k] in b" \n"), len(text))
        yield text[at:end]
        at = end
    yield text[at:]


class Ids(dict):
    """A number for each key, from 0 in order of first use."""

    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        return n


class Chunk:
    """Texts of one language as numbers. The first number, -1 in the end, stands between pieces and texts."""

    def __init__(self):
        self.ids, self.parts, self.size = Ids(), [], 0
        self.breaks = self.ids[BREAK]

    def add(self, text: bytes) -> None:
        self.size += len(text)
        for part in slices(text):
            words = [w for w in tokens(part) if w]
            self.parts.append(np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words)))
        self.parts.append(np.array([self.breaks], np.int32))

    def row(self) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Words by number, how often each occurs, and the sequence of numbers."""
        at = np.concatenate(self.parts) - 1
        words = list(self.ids)[1:]
        return words, np.bincount(at[at >= 0], minlength=len(words)), at


CHUNKS = pa.schema([("chunk", pa.int64()), ("lang", pa.string()), ("words", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64())), ("at", pa.binary())])


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first, n, held = TaskContext.get().partitionId() << 32, 0, {}

    def out() -> Iterator[pa.RecordBatch]:
        nonlocal n
        for lang in list(held):
            words, counts, at = held.pop(lang).row()
            yield pa.RecordBatch.from_arrays([pa.array([first + n]), pa.array([lang]), pa.array([words], CHUNKS.field("words").type), pa.array([counts.tolist()], CHUNKS.field("counts").type), pa.array([at.tobytes()])], schema=CHUNKS)
            n += 1

    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"], strict=True):
            held.setdefault(lang, Chunk()).add(text.as_py())
            if sum(c.size for c in held.values()) >= CHUNK:
                yield from out()
    yield from out()


def borders(parts: int = PARTS) -> np.ndarray:
    """The first ids of the bands that rows and columns of tiles come from: ``parts`` for each doubling, single ids at first."""
    found = sorted({(1 << k) + ((1 << k) * p) // parts for k in range(40) for p in range(parts)})
    return np.array(found, np.int64) - 1


def code_type(area: int) -> type:
    return np.uint32 if area <= 1 << 32 else np.uint64


LEVEL = "chunk long, lang string, tile_a int, tile_b int, base long, codes binary, counts binary, at binary"
_ARROW = pa.schema([("chunk", pa.int64()), ("lang", pa.string()), ("tile_a", pa.int32()), ("tile_b", pa.int32()), ("base", pa.int64()), ("codes", pa.binary()), ("counts", pa.binary()), ("at", pa.binary())])


def tiled(ids: np.ndarray) -> tuple[list[tuple], np.ndarray]:
    """Neighbours in a sequence of ids (-1: none), by tile: [(row, col, base, codes, counts)], and the number of each place's pair.

    Pairs are numbered through all tiles; ``base`` is the first number in a tile, whose codes ascend.
    """
    edge = borders()
    width = np.diff(edge, append=1 << 40)
    at = np.full(len(ids), -1, np.int64)
    places = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0)) if len(ids) > 1 else np.array([], np.int64)
    if not len(places):
        return [], at
    a, b = ids[places], ids[places + 1]
    row, col = (np.searchsorted(edge, x, "right") - 1 for x in (a, b))
    tile = (row * len(edge) + col).astype(np.int32)
    code = (a - edge[row]) * width[col] + (b - edge[col])
    order = np.argsort(tile, kind="stable")
    tile, code = tile[order], code[order]
    cuts = np.flatnonzero(np.diff(tile, prepend=-1))
    local, out, base = np.empty(len(order), np.int64), [], 0
    for start, end in zip(cuts.tolist(), [*cuts[1:].tolist(), len(tile)], strict=True):
        r, c = divmod(int(tile[start]), len(edge))
        area, own = int(width[r] * width[c]), code[start:end]
        if area <= DENSE * len(own):  # addressed directly
            filled = np.bincount(own, minlength=area)
            cells = np.flatnonzero(filled)
            counts = filled[cells]
            number_of = np.empty(area, np.int64)
            number_of[cells] = np.arange(len(cells))
            local[start:end] = base + number_of[own]
        else:
            cells, inverse, counts = np.unique(own, return_inverse=True, return_counts=True)
            local[start:end] = base + inverse
        out.append((r, c, base, cells.astype(code_type(area)).tobytes(), counts.astype(np.uint32).tobytes()))
        base += len(cells)
    at[places[order]] = local
    return out, at


def squeezed(at: np.ndarray) -> np.ndarray:
    """Without all but one of several -1 in a row."""
    return at[(at >= 0) | (np.concatenate([[0], at[:-1]]) >= 0)].astype(np.int32) if len(at) else at.astype(np.int32)


def _level(key: tuple, chunk: pa.Table, known: pa.Table) -> pa.Table:
    """A chunk with what its numbers became, as tiles of pairs and a sequence of pairs. ``known``: (of, local, id), or several in a row as bytes."""
    if not chunk.num_rows or not known.num_rows:
        return _ARROW.empty_table()
    at = np.frombuffer(chunk["at"][0].as_py(), np.int32)
    of = np.full(max(int(at.max(initial=0)), 0) + 2, -1, np.int64)
    if "local" in known.column_names:
        of[known["local"].to_numpy()] = known["id"].to_numpy()
    else:
        local, ids = (b"".join(known[c].to_pylist()) for c in ("locals", "ids"))
        of[np.frombuffer(local, np.int32)] = np.frombuffer(ids, np.int64)
    of[-1] = -1  # where -1 leads
    tiles, pairs = tiled(of[at])
    if not tiles:
        return _ARROW.empty_table()
    row, col, base, codes, counts = zip(*tiles, strict=True)
    n, own, lang = len(tiles) + 1, chunk["chunk"][0].as_py(), chunk["lang"][0].as_py()
    columns = [[own] * n, [lang] * n, [None, *row], [None, *col], [None, *base], [None, *codes], [None, *counts], [squeezed(pairs).tobytes(), *[None] * len(tiles)]]
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


class Sums:
    """Counts of the cells of one tile."""

    def __init__(self, row: int, col: int):
        edge = borders()
        width = np.diff(edge, append=1 << 40)
        self.first, self.width, self.area = (edge[row], edge[col]), int(width[col]), int(width[row] * width[col])
        self.dense = np.zeros(self.area, np.int64) if self.area <= CELLS else None
        self.codes, self.counts, self.gathered = [], [], 0

    def add(self, codes: bytes, counts: bytes) -> None:
        codes, counts = np.frombuffer(codes, code_type(self.area)), np.frombuffer(counts, np.uint32).astype(np.int64)
        if self.dense is not None:
            self.dense[codes] += counts  # a block has a cell once
            return
        self.codes.append(codes)
        self.counts.append(counts)
        self.gathered += len(codes)
        if self.gathered > GATHERED:
            self.sum_up()
            self.gathered = len(self.codes[0]) // 2  # sums that stay count half, so that they are not sorted again and again

    def sum_up(self) -> None:
        codes, counts = np.concatenate(self.codes), np.concatenate(self.counts)
        order = np.argsort(codes, kind="stable")
        codes, counts = codes[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        self.codes, self.counts = [codes[first]], [np.add.reduceat(counts, first)]

    def frequent(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a, b, f) of the cells counted ``least`` times or more."""
        if self.dense is not None:
            codes = np.flatnonzero(self.dense >= least)
            f = self.dense[codes]
        else:
            self.sum_up()
            some = self.counts[0] >= least
            codes, f = self.codes[0][some].astype(np.int64), self.counts[0][some]
        return self.first[0] + codes // self.width, self.first[1] + codes % self.width, f


def _sums(least: int):
    schema = pa.schema([("lang", pa.string()), ("tile_a", pa.int32()), ("tile_b", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("f", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, None

        def out() -> Iterator[pa.RecordBatch]:
            if sums is not None and len((found := sums.frequent(least))[0]):
                n = len(found[0])
                yield pa.RecordBatch.from_arrays([pa.array([x] * n, t.type) for x, t in zip(now, schema, strict=False)] + [pa.array(x, pa.int64()) for x in found], schema=schema)

        for batch in batches:
            for *key, codes, counts in zip(*(batch[c].to_pylist() for c in ("lang", "tile_a", "tile_b", "codes", "counts")), strict=True):
                if key != now:
                    yield from out()
                    now, sums = key, Sums(key[1], key[2])
                sums.add(codes, counts)
        yield from out()

    return run


FOUND = pa.schema([("of", pa.int64()), ("locals", pa.binary()), ("ids", pa.binary())])


def _found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(of, locals, ids): of each chunk's blocks the pairs that are frequent. A tile's list of these comes before its blocks."""
    edge = borders()
    width = np.diff(edge, append=1 << 40)
    now = None
    for batch in batches:
        lists, out = batch["ids"], []
        for k, (*tile, chunk, base, codes) in enumerate(zip(*(batch[c].to_pylist() for c in ("lang", "tile_a", "tile_b", "chunk", "base", "codes")), strict=True)):
            row, col = tile[1:]
            if chunk is None:
                of = lists[k].values
                a, b, ids = (of.field(c).to_numpy() for c in ("a", "b", "id"))
                wanted = (a - edge[row]) * width[col] + (b - edge[col])
                order = np.argsort(wanted)
                now, wanted, ids = tile, wanted[order], ids[order]
            elif tile == now:
                own = np.frombuffer(codes, code_type(int(width[row] * width[col]))).astype(np.int64)
                at = np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)
                hit = np.flatnonzero(wanted[at] == own)
                if len(hit):
                    out.append((chunk, (base + hit).astype(np.int32).tobytes(), ids[at[hit]].tobytes()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), FOUND, strict=True)], schema=FOUND)


def ranked(frequent: DataFrame, *key: str) -> DataFrame:
    """``frequent`` (lang, ..., f) with ``id``: its place among its language's, from 0, the most frequent first."""
    told = number(frequent.withColumn("_f", -F.col("f")), "lang", "_f", *key)
    first = told.groupBy("lang").agg(F.min("row").alias("_first"))
    return told.join(first, "lang").withColumn("id", F.col("row") - F.col("_first")).drop("row", "_f", "_first")


class Written:
    """Tables in the shared folder that only this run reads."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/phrases-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{self.folder}/{name}")
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def drop(self, name: str = "") -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, most: int = 2000, cover: int = 80) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``most`` best phrases of 2 to ``longest`` words.

    Phrases that occur ``least`` times count. Cut after its first words, a phrase that occurs a times scores
    floor(2000000 a / (l + r)), where its parts occur l and r times; its worst cut counts (the shortest
    first part of equal ones). A phrase goes if a longer one around it has ``cover`` percent of its
    occurrences or more. Ties go by a, then by the phrase's bytes.

    Null texts are empty, a null language is ``und``; every row counts, repeated ones too, and
    other columns are ignored. Tables without frequent phrases give no rows.
    """
    spark = docs.sparkSession
    kept = Written(spark)
    texts = docs.where(F.col("text").isNotNull()).select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    chunks = kept.table(texts.mapInArrow(_chunks, "chunk long, lang string, words array<binary>, counts array<long>, at binary"), "words")
    words = chunks.select("chunk", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("local", "x")).select("chunk", "lang", "local", F.col("x.words").alias("word"), F.col("x.counts").alias("k"))
    counted = words.groupBy("lang", "word").agg(F.sum("k").alias("f"))
    n = stable(counted.groupBy("lang").agg(F.sum("f").alias("n")))
    frequent = stable(ranked(counted.where(F.col("f") >= least), "word"))
    known = words.join(frequent, ["lang", "word"]).select(F.col("chunk").alias("of"), "local", "id")
    text = F.col("word").cast("string")
    phrases = [frequent.select("lang", "id", F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"), "f", text.alias("phrase"), text.alias("last"), F.array("f").alias("left"), F.array("f").alias("right"))]
    sequence, before = chunks.select("chunk", "lang", "at"), "words"
    for size in range(2, longest + 1):
        level = kept.table(sequence.groupBy("chunk").cogroup(known.groupBy("of")).applyInArrow(_level, LEVEL), str(size))
        kept.drop(before)
        blocks = level.where("tile_a IS NOT NULL").select("chunk", "lang", "tile_a", "tile_b", "base", "codes", "counts")
        tiles = ["lang", "tile_a", "tile_b"]
        sums = blocks.select(*tiles, "codes", "counts").repartition(*tiles).sortWithinPartitions(*tiles).mapInArrow(_sums(least), "lang string, tile_a int, tile_b int, a long, b long, f long")
        frequent = stable(ranked(sums, "a", "b"))
        of = [phrases[-1].select("lang", F.col("id").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("phrase", "last", "left", "right")]) for c in "ab"]
        both = frequent.join(of[0], ["lang", "a"]).join(of[1], ["lang", "b"])
        phrases.append(stable(both.select("lang", "id", "a", "b", "f", F.concat_ws(" ", "phrase_a", "last_b").alias("phrase"), F.col("last_b").alias("last"), F.concat("left_a", F.array("f")).alias("left"), F.concat("right_b", F.array("f")).alias("right"))))
        if size < longest:
            lists = frequent.groupBy(*tiles).agg(F.collect_list(F.struct("a", "b", "id")).alias("ids"))
            # A tile's list and its blocks in one order, so that the list is sent to a task once.
            both = blocks.select(*tiles, "chunk", "base", "codes").unionByName(lists, allowMissingColumns=True)
            known = both.repartition(*tiles).sortWithinPartitions(*tiles, "chunk").mapInArrow(_found, "of long, locals binary, ids binary")
            sequence, before = level.where("at IS NOT NULL").select("chunk", "lang", "at"), str(size)
    kept.drop()
    return _best(phrases, n, most, cover)


def _best(phrases: list[DataFrame], n: DataFrame, most: int, cover: int) -> DataFrame:
    out = None
    for k, own in enumerate(phrases[1:], 1):  # phrases of k + 1 words
        if k + 1 < len(phrases):
            # Longer ones yet have no more occurrences than those of one word more.
            around = phrases[k + 1].select("lang", F.explode(F.array("a", "b")).alias("id"), F.col("f").alias("_f")).groupBy("lang", "id").agg(F.max("_f").alias("_f"))
            own = own.join(around, ["lang", "id"], "left").where(F.coalesce(100 * F.col("_f") < cover * F.col("f"), F.lit(True)))
        cuts = [F.struct(F.expr(f"(CAST(2000000 AS DECIMAL(7, 0)) * CAST(f AS DECIMAL(20, 0))) DIV CAST(left[{j - 1}] + right[{k - j}] AS DECIMAL(20, 0))").alias("score"), F.lit(j).alias("k"), F.get("left", F.lit(j - 1)).alias("l"), F.get("right", F.lit(k - j)).alias("r")) for j in range(1, k + 1)]
        cut = own.select("lang", "phrase", F.col("f").alias("a"), F.array_min(F.array(*cuts)).alias("_cut")).select("lang", "phrase", "a", "_cut.l", "_cut.r", "_cut.score")
        out = cut if out is None else out.unionByName(cut)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return best.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
