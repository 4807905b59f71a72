"""Token ids as Arrow IPC files: record batches of fixed-size lists, one list a training sequence.

A file holds the ids of its documents one after the other, cut into rows of ``length`` ids with
a mask that is false where the last row is padded; its index file holds where each document
lies. All rows of a file are equally long, so that sequence k is found by arithmetic and read
from a memory map without copying. Files follow one another in ascending order of doc_id.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from elutra.llm.bpe import Encoder
from elutra.llm.shared import shared_folder, stable

LENGTH, ROWS = 2048, 128
#: Words whose ids a task remembers.
MAX_WORDS = 400_000


class LibraryEncoder:
    """ids of texts as little-endian unsigned 32-bit integers, as the tokenizers library gives them without special tokens added.

    A byte-level tokenizer never merges over the blank before a word, so the library gets each word
    once. A text that spells a special token goes to it whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task for each core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        own = json.loads(self.tokenizer.to_str())
        if own["normalizer"] or (own["pre_tokenizer"] or {}).get("type") != "ByteLevel" or own["pre_tokenizer"]["add_prefix_space"] or not own["pre_tokenizer"]["use_regex"]:
            raise ValueError("a byte-level tokenizer that splits by its pattern and changes no text is wanted")
        self.special = [token["content"] for token in own["added_tokens"]]
        self.line_end = self._ids("\n")
        self.words = Encoder(self._of_parts, MAX_WORDS)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _of_parts(self, parts: list[str]) -> Iterator[bytes]:
        """Those without other white space than a blank before them and single line ends inside go to the library
        in one text, on as many lines as they have: it splits at line ends."""
        lines_of = [len(own) if (own := part.split()) and "\n".join(own) == part.removeprefix(" ") else 0 for part in parts]
        ids = self._ids("".join([part + "\n" for part, n in zip(parts, lines_of, strict=True) if n]))
        ends = np.flatnonzero(ids == self.line_end[0]).tolist()
        data, at, k = ids.tobytes(), 0, 0
        for part, n in zip(parts, lines_of, strict=True):
            if n:
                k += n
                yield data[4 * at : 4 * ends[k - 1]]
                at = ends[k - 1] + 1
            else:
                yield self._ids(part).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = [any(x in text for x in self.special) for text in texts]
        found = self.words.encode(["" if own else text for text, own in zip(texts, whole, strict=True)])
        for k in np.flatnonzero(whole).tolist():
            found[k] = self._ids(texts[k]).tobytes()
        return found


def batches(rows: Iterable[tuple], most: int = 1 << 22) -> Iterator[list[tuple]]:
    """Rows (doc_id, text) in batches of about ``most`` characters; a longer text is one of its own."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[1])
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


@lru_cache(maxsize=1)
def encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def schema(length: int, kind: pa.DataType) -> pa.Schema:
    return pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])


LISTED = pa.schema([("path", pa.string()), ("part", pa.int32()), ("first_doc_id", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class Writer:
    """One data file and its index; memory holds one record batch."""

    def __init__(self, uri: str, length: int, kind: pa.DataType, rows: int = ROWS):
        self.files, self.path = fs.FileSystem.from_uri(uri)
        self.length, self.kind, self.rows = length, kind, rows
        self.streams = [self.files.open_output_stream(self.path + end) for end in ("", ".index")]
        self.data = pa.ipc.new_file(self.streams[0], schema(length, kind))
        self.index = pa.ipc.new_file(self.streams[1], INDEX)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_tokens = 0
        self.places: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.places.append((doc_id, self.n_tokens, len(ids)))
        self.n_tokens += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.rows * self.length:
            self._flush(last=False)
        if len(self.places) >= 65_536:
            self._flush_index()

    def _flush(self, last: bool) -> None:
        flat = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        size = self.rows * self.length
        full = len(flat) // size * size  # all batches but the last have equally many rows
        end = -(-len(flat) // self.length) * self.length if last else full
        for lo in range(0, end, size):
            part = flat[lo : min(end, lo + size)]
            mask = np.ones(len(part), bool)
            pad = -len(part) % self.length
            part, mask = np.pad(part, (0, pad)), np.pad(mask, (0, pad))
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(part.astype(self.kind.to_pandas_dtype())), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)]
            self.data.write_batch(pa.RecordBatch.from_arrays(lists, schema=schema(self.length, self.kind)))
        self.held, self.n_held = [flat[end:]] if end < len(flat) else [], max(0, len(flat) - end)

    def _flush_index(self) -> None:
        columns = zip(*self.places, strict=True) if self.places else ([], [], [])
        self.index.write_batch(pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], schema=INDEX))
        self.places = []

    def close(self) -> None:
        self._flush(last=True)
        self._flush_index()
        for x in (self.data, self.index, *self.streams):
            x.close()


class Reader:
    """Random access to the sequences of a file, and its documents in turn."""

    def __init__(self, uri: str):
        files, path = fs.FileSystem.from_uri(uri)
        opened = lambda p: pa.memory_map(p) if isinstance(files, fs.LocalFileSystem) else files.open_input_file(p)
        self.data, self.index = pa.ipc.open_file(opened(path)), pa.ipc.open_file(opened(path + ".index"))
        self.length = self.data.schema.field("ids").type.list_size
        self.rows = self.data.get_batch(0).num_rows if self.data.num_record_batches else 0
        self.at, self.batch = -1, None

    def _batch(self, k: int) -> pa.RecordBatch:
        if k != self.at:
            self.at, self.batch = k, self.data.get_batch(k)
        return self.batch

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of row k."""
        batch, row = self._batch(k // self.rows), k % self.rows
        return batch.column(0)[row].values.to_numpy(), batch.column(1)[row].values.to_numpy(zero_copy_only=False)

    def ids(self, start: int, n: int) -> np.ndarray:
        """The ids from place ``start`` of the file on."""
        size, found = self.rows * self.length, []
        while n > 0:
            flat = self._batch(start // size).column(0).flatten()
            part = flat.slice(start % size, min(n, len(flat) - start % size)).to_numpy()
            if not len(part):
                raise ValueError("the file ends before the document does")
            found.append(part)
            start, n = start + len(part), n - len(part)
        return np.concatenate(found) if len(found) != 1 else found[0]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        for k in range(self.index.num_record_batches):
            for row in zip(*[c.to_pylist() for c in self.index.get_batch(k).columns], strict=True):
                yield row[0], row[1], self.ids(row[1], row[2])


def write(docs: DataFrame, path: str, folder: str | None = None, end_id: int = 2, length: int = LENGTH, vocabulary: int = 50_257) -> DataFrame:
    """Writes the ids of ``docs`` (doc_id, text) below ``folder`` and gives the list of files, which is kept.

    (path, part, first_doc_id, n_docs, n_tokens, start); start counts the ids of all files before.
    Documents are dealt to files by ranges of doc_id and sorted within, null ones first. Rows of one
    doc_id may lie in several files: they are ordered by a hash of their text, and repeated rows by
    the place they were read from. A task that runs again writes a file of another name, and only
    the files of tasks that ended well are listed. Null texts have but the end id. Ids are of 16
    bits where the vocabulary allows it.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    kind = pa.uint16() if vocabulary <= 1 << 16 else pa.uint32()
    end = struct.pack("<I", end_id)

    def of_task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, writer, first, n = encoder(path), None, None, 0
        rows = ((i, t or "") for part in parts for i, t in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True))
        for batch in batches(rows):
            if writer is None:
                files, at = fs.FileSystem.from_uri(folder)
                files.create_dir(at, recursive=True)
                uri = f"{folder}/{uuid.uuid4().hex}.arrow"
                writer, first = Writer(uri, length, kind), batch[0][0]
            for (doc_id, _), data in zip(batch, coder.encode([t for _, t in batch]), strict=True):
                writer.add(doc_id, np.frombuffer(data + end, "<u4"))
                n += 1
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pylist([{"path": uri, "part": TaskContext.get().partitionId(), "first_doc_id": first, "n_docs": n, "n_tokens": writer.n_tokens}], LISTED)

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.spark_partition_id()]
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(*order).sortWithinPartitions(*order[:2])
    listed = stable(dealt.mapInArrow(of_task, "path string, part int, first_doc_id long, n_docs long, n_tokens long"))
    # A row for each file: one task can number them. Parts are in the order of their ranges.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return listed.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read(listed: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files of ``listed``, as the files hold them."""

    def of_files(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for path, start in zip(part["path"].to_pylist(), part["start"].to_pylist(), strict=True):
                rows = []
                for doc_id, at, ids in Reader(path).documents():
                    rows.append((doc_id, start + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(rows) == 10_000:
                        yield _rows(rows)
                        rows = []
                yield _rows(rows)

    spread = listed.select("path", "start").repartition(max(1, listed.count()))
    return spread.mapInArrow(of_files, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])
