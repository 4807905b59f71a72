"""Repair of the turn structure of conversations, by dynamic programming over a grammar of their faults.

A row is one of nine letters: it must go, or it has one of four kinds of role and its text ends well or not.
A conversation is a word of such letters. The words of a batch are compressed by Re-Pair: the most frequent pair
of neighbours becomes a symbol, again and again. Every symbol has one min-plus matrix, from the state before to
the state after, whose entries also lead to their edits: a rope, made of the symbol's two parts. Matrices are made from
the bottom up, once for all conversations; a conversation then is a short product.

Conversations of usual size come together in a task, as many as fit a batch. Longer ones are cut into pieces
of rows: matrices of pieces are multiplied, and each piece is repaired between the states that the whole needs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from elutra.llm.shared import small_side, stable

#: Rows and bytes of text from which a conversation is cut into pieces, of so many rows; and rows that are compressed together.
ROWS, BYTES, BATCH = 4096, 4 << 20, 20_000
#: A pair of symbols becomes a rule if it occurs so often.
LEAST = 8

# Costs of edits.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)  # what was put out last
NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
INSERTS = {START: {START: 0, USER: 1, ASSISTANT: 2}, SYSTEM: {SYSTEM: 0, USER: 1, ASSISTANT: 2}, USER: {USER: 0, ASSISTANT: 1}, ASSISTANT: {ASSISTANT: 0, USER: 1}}
NEVER = 1 << 40
LETTERS = "suaoSUAOx"  # by role; capitals: truncated; x: must go
SPACE = " \t\n\x0b\x0c\r"


class Symbol:
    """A matrix of costs, where each entry leads to its edits.

    ``order[p]`` ranks the edits that lead from p to each state by their text. Edits of one word always end with that of
    its last letter, so of two texts neither begins the other, and their order decides that of any continuations.
    """

    def __init__(self, costs: list[list[int]], order: list[list[int]], texts: dict | None = None, parts: tuple | None = None, middle: list[list[int]] | None = None):
        self.costs, self.order, self.texts, self.parts, self.middle = costs, order, texts or {}, parts, middle

    @classmethod
    def letter(cls, letter: str) -> Symbol:
        best: dict[tuple[int, int], tuple[int, str]] = {}
        late = TRUNCATED * letter.isupper()
        for p, inserted in INSERTS.items():
            for m, k in inserted.items():
                ways = [(m, DELETE, "D")]
                if letter != "x":
                    ways += [(NEXT[letter.lower()][m], late, "K")] if m in NEXT.get(letter.lower(), {}) else []
                    ways += [(NEXT[r][m], REROLE + late, "R") for r in "ua" if m in NEXT[r]]
                for q, cost, edit in ways:
                    best[p, q] = min(best.get((p, q), (NEVER, "")), (cost + INSERT * k, "I" * k + edit))
        costs = [[best.get((p, q), (NEVER,))[0] for q in range(4)] for p in range(4)]
        texts = {pq: text for pq, (_, text) in best.items()}
        order = [ranks([(texts.get((p, q), "~"),) for q in range(4)]) for p in range(4)]
        return cls(costs, order, texts)

    @classmethod
    def rule(cls, a: Symbol, b: Symbol) -> Symbol:
        costs, order, middle = [], [], []
        for p in range(4):
            ways = [min((a.costs[p][m] + b.costs[m][q], a.order[p][m], m) for m in range(4)) for q in range(4)]
            costs.append([min(NEVER, w[0]) for w in ways])
            middle.append([w[2] for w in ways])
            order.append(ranks([(w[1], b.order[w[2]][q]) if w[0] < NEVER else (9, 9) for q, w in enumerate(ways)]))
        return cls(costs, order, None, (a, b), middle)

    def text(self, p: int, q: int) -> str:
        """The edits from p to q."""
        if (p, q) not in self.texts:
            out, left = [], [(self, p, q)]
            while left:
                symbol, p1, q1 = left.pop()
                if (known := symbol.texts.get((p1, q1))) is not None:
                    out.append(known)
                else:
                    m = symbol.middle[p1][q1]
                    left += [(symbol.parts[1], m, q1), (symbol.parts[0], p1, m)]
            self.texts[p, q] = "".join(out)
        return self.texts[p, q]


def ranks(keys: list) -> list[int]:
    told = sorted(set(keys))
    return [told.index(k) for k in keys]


def path(symbols: list) -> tuple[int, list[int], int]:
    """(cost, states, inserts) of the cheapest way through ``symbols`` (costs, order): the states around them, and rows put in at the end."""
    costs, order, back = [0, NEVER, NEVER, NEVER], [0, 1, 1, 1], []
    for c, o in symbols:
        ways = [min((costs[m] + c[m][q], order[m], m) for m in range(4)) for q in range(4)]
        back.append([w[2] for w in ways])
        costs = [min(NEVER, w[0]) for w in ways]
        order = ranks([(w[1], o[w[2]][q]) if w[0] < NEVER else (9, 9) for q, w in enumerate(ways)])
    ends = {m: 0 if m == START else INSERTS[m][ASSISTANT] for m in range(4)}
    cost, _, state = min((costs[m] + INSERT * ends[m], order[m], m) for m in range(4))
    states = [state]
    for b in reversed(back):
        states.append(b[states[-1]])
    return cost, states[::-1], ends[state]


class Grammar:
    """Rules for a batch of words."""

    letters = {x: Symbol.letter(x) for x in LETTERS}

    def __init__(self, words: Iterable[str], least: int = LEAST):
        self.words = list(dict.fromkeys(words))
        at = np.full(sum(map(len, self.words)) + len(self.words), -1, np.int64)
        start, number = 0, {x: k for k, x in enumerate(LETTERS)}
        for word in self.words:
            at[start : start + len(word)] = [number[x] for x in word]
            start += len(word) + 1
        self.symbols = [self.letters[x] for x in LETTERS]
        while len(at) > 1:
            n = len(self.symbols)
            pairs = np.where((at[:-1] >= 0) & (at[1:] >= 0), at[:-1] * n + at[1:], n * n)
            counts = np.bincount(pairs, minlength=n * n + 1)[:-1]
            best = int(counts.argmax())
            if counts[best] < least:
                break
            a, b = divmod(best, n)
            hits = np.flatnonzero(pairs == best)
            if a == b:  # of a run every other place
                first = np.flatnonzero(np.diff(hits, prepend=-2) != 1)
                hits = hits[(np.arange(len(hits)) - np.repeat(first, np.diff(first, append=len(hits)))) % 2 == 0]
            at[hits] = n
            at = np.delete(at, hits + 1)
            self.symbols.append(Symbol.rule(self.symbols[a], self.symbols[b]))
        cuts = np.flatnonzero(at < 0).tolist()
        self.of = {word: [self.symbols[k] for k in at[s:e].tolist()] for word, s, e in zip(self.words, [0, *(c + 1 for c in cuts)], cuts, strict=False)}

    def repaired(self, word: str) -> tuple[int, str]:
        """Cost and edits of a whole conversation."""
        symbols = self.of[word]
        cost, states, inserts = path([(s.costs, s.order) for s in symbols])
        return cost, "".join([s.text(p, q) for s, p, q in zip(symbols, states, states[1:], strict=False)]) + "I" * inserts

    def whole(self, word: str) -> Symbol:
        """One symbol for a word that isn't empty."""
        row = self.of[word]
        while len(row) > 1:
            row = [Symbol.rule(*row[k : k + 2]) if k + 1 < len(row) else row[k] for k in range(0, len(row), 2)]
        return row[0]


def letter_of(role: str, must_go: bool, truncated: bool) -> str:
    if must_go:
        return "x"
    kind = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return kind.upper() if truncated else kind


def edited(edits: str, rows: Iterable[tuple[str, str]], state: int = START) -> Iterator[str]:
    """``role:text`` of each row that the edits put out, where ``state`` was put out before."""
    rows = iter(rows)
    for edit in edits:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit != "K":
            role = "assistant" if state == USER else "user"
        state = NEXT[role[0]][state]
        yield f"{role}:{text}"


ILLEGAL_UNLESS = {("s", "u"), ("u", "a"), ("a", "u")}


def stats(rows: list[tuple]) -> dict[str, int]:
    """Sums over rows (turn, role, text, fault) in order."""
    faults = [r[3] for r in rows]
    initials = [r[1][:1] for r in rows]
    turns = [r[0] for r in rows if r[0] is not None]
    return {
        "low": min(turns, default=None),
        "high": max(turns, default=None),
        "turns": len(set(turns)),
        **{name: faults.count(name) for name in ("blank", "duplicate", "truncated")},
        "illegal": sum(pair not in ILLEGAL_UNLESS for pair in zip(initials, initials[1:], strict=False)),
    }


def fault_of(text: Column) -> Column:
    """blank, truncated or NULL. White space is U+0020 and U+0009 to U+000D."""
    last = F.substring(F.rtrim(text, F.lit(SPACE)), -1, 1)
    return F.when(F.length(last) == 0, "blank").when(~last.isin(".", "!", "?"), "truncated")


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy, dropped): rows with faults put in by crc32 of ``conv_id:turn``, modulo 20.

    0 drops a row (it stays, marked), 1 empties its text, 2 takes its sentence marks, 3 repeats it, 4 makes it a user's.
    Nulls count as one space; a null turn stays one.
    """
    space = F.lit(" ")
    known = lambda c: F.coalesce(F.col(c).cast("string"), space)
    kind = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn"))) % 20
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace(known("text"), "[.!?]", "")).otherwise(known("text"))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", kind.alias("_kind"))
    rows = rows.select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(known("role")).alias("role"), text.alias("text"), "_kind")
    copies = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", "role", "text", copies.alias("copy"), (F.col("_kind") == 0).alias("dropped"))


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
COUNTS = ("blank", "duplicate", "truncated", "illegal")


def _result(conv_id, sums: dict[str, int], cost: int, edits: str, digest: str) -> tuple:
    gaps = 0 if sums["low"] is None else sums["high"] - sums["low"] + 1 - sums["turns"]
    return conv_id, gaps, *(sums[c] for c in COUNTS), cost, edits, digest


def repair_batch(batch: list[tuple[object, list[tuple]]], with_text: bool) -> list[tuple]:
    """Results for whole conversations [(conv_id, rows)]; rows are (turn, role, text, fault) in order, duplicates not told yet."""
    found = []
    for conv_id, rows in batch:
        seen, told = set(), []
        for turn, role, text, fault in rows:
            if fault != "blank" and (role, text) in seen:
                fault = "duplicate"
            seen.add((role, text))
            told.append((turn, role, text, fault))
        found.append((conv_id, told, "".join([letter_of(r[1], r[3] in ("blank", "duplicate"), r[3] == "truncated") for r in told])))
    grammar = Grammar(word for _, _, word in found)
    repaired = {word: grammar.repaired(word) for word in grammar.words}
    out = []
    for conv_id, rows, word in found:
        cost, edits = repaired[word]
        text = "\n".join(edited(edits, ((r[1], r[2]) for r in rows)))
        out.append((*_result(conv_id, stats(rows), cost, edits, hashlib.sha256(text.encode()).hexdigest()), *([text] if with_text else [])))
    return out


def _whole(schema: pa.Schema, with_text: bool):
    """Rows in order to results, for conversations that are whole in a task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n, now, rows = [], 0, None, None

        def out() -> pa.RecordBatch:
            columns = zip(*repair_batch(waiting, with_text), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            for conv_id, turn, role, text, fault, dropped in zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "role", "text", "fault", "dropped")), strict=True):
                if rows is None or conv_id != now:
                    if n >= BATCH:
                        yield out()
                        waiting, n = [], 0
                    now, rows = conv_id, []
                    waiting.append((now, rows))
                if not dropped:
                    rows.append((turn, role, text, fault))
                    n += 1 + len(text) // 400
        if waiting:
            yield out()

    return run


PIECE = "part long, roles array<string>, texts array<string>, word string, costs array<long>, orders array<int>, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, first string, last string"


def _pieces(schema: pa.Schema, size: int):
    """Rows in order to pieces of at most ``size`` rows, each with its matrix. ``part`` ascends."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, rows = TaskContext.get().partitionId() << 32, None, None

        def out() -> pa.RecordBatch:
            word = "".join([letter_of(r[1], r[3] in ("blank", "duplicate"), r[3] == "truncated") for r in rows])
            whole = Grammar([word]).whole(word) if word else None
            costs, orders = (sum(x, []) for x in ((whole.costs, whole.order) if word else ([], [])))
            sums = stats(rows)
            texts = ["" if r[3] in ("blank", "duplicate") else r[2] for r in rows]  # of rows that go nobody asks for the text
            row = [now, part, [r[1] for r in rows], texts, word, costs, orders, *(sums[c] for c in ("low", "high", "turns", *COUNTS)), rows[0][1][:1] if rows else None, rows[-1][1][:1] if rows else None]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

        bytes_held = 0
        for batch in batches:
            for conv_id, turn, role, text, fault, dropped in zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "role", "text", "fault", "dropped")), strict=True):
                if rows is None or conv_id != now or len(rows) >= size or bytes_held >= BYTES:
                    if rows is not None:
                        yield out()
                        part += 1
                    now, rows, bytes_held = conv_id, [], 0
                if not dropped:
                    rows.append((turn, role, text, fault))
                    bytes_held += len(text)
        if rows is not None:
            yield out()

    return run


def _states(frame: pd.DataFrame) -> pd.DataFrame:
    """Of the pieces of one conversation: the states before and after each, and what the whole costs. Matrices only."""
    frame = frame.sort_values("part")
    some = [k for k, c in enumerate(frame["costs"]) if len(c)]
    square = lambda x: np.reshape(x, (4, 4)).tolist()
    cost, states, inserts = path([(square(frame["costs"].iloc[k]), square(frame["orders"].iloc[k])) for k in some])
    before, after, at = [], [], 0
    for k in range(len(frame)):
        before.append(states[at])
        at += k in set(some[at : at + 1])
        after.append(states[at])
    end = [0] * (len(frame) - 1) + [inserts]
    return pd.DataFrame({"part": frame["part"], "before": before, "after": after, "inserts": end, "cost": cost})


def _repaired_pieces(schema: pa.Schema):
    """Pieces with their edits and their text; a piece that puts rows out ends with a line break."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                own = (Grammar([r["word"]]).whole(r["word"]).text(r["before"], r["after"]) if r["word"] else "") + "I" * r["inserts"]
                text = "".join([f"{line}\n" for line in edited(own, zip(r["roles"], r["texts"], strict=True), r["before"])])
                yield pa.RecordBatch.from_pylist([{**{c: r[c] for c in schema.names if c in r}, "edits": own, "text": text}], schema=schema)

    return run


def _joined(schema: pa.Schema, with_text: bool):
    """Pieces in order to results; only the digest of the text is carried on, and the text itself if it is asked for."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = started = None
        rows: dict = {}

        def out() -> pa.RecordBatch:
            sums = {"low": rows["low"], "high": rows["high"], "turns": rows["turns"], **{c: rows[c] for c in COUNTS}}
            row = [*_result(now, sums, rows["cost"], "".join(rows["edits"]), rows["digest"].hexdigest()), *(["".join(rows["text"])] if with_text else [])]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            for r in batch.to_pylist():
                if not started or r["conv_id"] != now:
                    if started:
                        yield out()
                    now, started = r["conv_id"], True
                    rows = {"low": None, "high": None, "turns": 0, **dict.fromkeys(COUNTS, 0), "cost": r["cost"], "edits": [], "text": [], "digest": hashlib.sha256(), "last": None, "open": False}
                if r["low"] is not None:
                    rows["turns"] += r["turns"] - (rows["high"] == r["low"])
                    rows["low"] = r["low"] if rows["low"] is None else rows["low"]
                    rows["high"] = r["high"]
                for c in COUNTS:
                    rows[c] += r[c]
                if r["first"] is not None:
                    rows["illegal"] += rows["last"] is not None and (rows["last"], r["first"]) not in ILLEGAL_UNLESS
                    rows["last"] = r["last"]
                rows["edits"].append(r["edits"])
                if text := r["text"]:  # its last line break waits for the next line
                    own = ("\n" if rows["open"] else "") + text[:-1]
                    rows["open"] = True
                    rows["digest"].update(own.encode())
                    if with_text:
                        rows["text"].append(own)
        if started:
            yield out()

    return run


def _schema(rows: DataFrame, fields: str) -> tuple[str, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    told = f"conv_id {dict(rows.dtypes)['conv_id']}, {fields}"
    return told, to_arrow_schema(StructType.fromDDL(told))


def repair(rows: DataFrame, with_text: bool = False, most_rows: int = ROWS, most_bytes: int = BYTES) -> DataFrame:
    """One row for each conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 (and repaired).

    ``rows``: (conv_id, turn, role, text, copy, dropped), as ``damaged`` gives them; role and text aren't null. A conversation's
    rows go by turn (null ones first), role, text and copy. ``audit`` is the cheapest row of edits (Keep, Rerole, Delete, Insert) after
    which roles follow ``(s?(ua)+)?`` by their first letters; of equally cheap ones the first in the order of their letters.
    A conversation whose rows are all dropped has zeros and empty texts. A null conv_id is a conversation
    as well. Other columns are ignored; an empty table gives none.

    Conversations of more than ``most_rows`` rows or ``most_bytes`` bytes of text go by pieces: their duplicates are found
    by grouping, their rows dealt by ranges. Only the digest, which is defined on the whole text in order, and the audit, which is one
    string, pass all pieces of a conversation through one task, piece by piece.
    """
    with_text_field = f"{RESULT}, repaired string" if with_text else RESULT
    told, schema = _schema(rows, with_text_field)
    rows = rows.select("conv_id", "turn", "role", "text", "copy", "dropped")
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size"))
    large = small_side(stable(sizes.where((F.col("n") > most_rows) | (F.col("size") > most_bytes)).select(F.col("conv_id").alias("_large"))))
    same = F.col("conv_id").eqNullSafe(F.col("_large"))
    order = ["conv_id", "turn", "role", "text", "copy"]
    usual = rows.join(large, same, "left_anti").withColumn("fault", fault_of(F.col("text")))
    whole = usual.repartition("conv_id").sortWithinPartitions(*order).drop("copy").mapInArrow(_whole(schema, with_text), told)

    # Of a long conversation equal rows are one, with their number, until they are in order.
    rest = rows.join(large, same, "left_semi").groupBy("conv_id", "turn", "role", "text", "dropped").agg(F.count("*").alias("n"))
    first = rest.where("not dropped").groupBy(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("text").alias("_text")).agg(F.min(F.struct("turn")).alias("_first"))
    marked = rest.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("text") == F.col("_text")), "left")
    again = (F.col("copy") > 0) | ~F.col("turn").eqNullSafe(F.col("_first.turn"))
    fault = fault_of(F.col("text"))
    one_by_one = marked.withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
    one_by_one = one_by_one.select(*order, "dropped", F.when(fault == "blank", "blank").when(again, "duplicate").otherwise(fault).alias("fault"))
    told_piece, piece_schema = _schema(rows, PIECE)
    pieces = stable(one_by_one.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pieces(piece_schema, most_rows), told_piece))
    states = pieces.select("conv_id", "part", "costs", "orders").groupBy("conv_id").applyInPandas(_states, "part long, before int, after int, inserts int, cost long")
    joined = pieces.drop("costs", "orders").join(states, "part")
    told_text, text_schema = _schema(rows, "part long, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, first string, last string, cost long, edits string, text string")
    done = joined.mapInArrow(_repaired_pieces(text_schema), told_text)
    long = done.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_joined(schema, with_text), told)
    return whole.unionByName(long)
