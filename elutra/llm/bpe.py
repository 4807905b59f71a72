"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decoding.

A token sequence is the BPE encoding of its bytes exactly when every token encodes to itself
and every two neighbours, joined, encode to themselves again. A nondeterministic transducer
can therefore guess tokens byte by byte and drop guesses whose neighbours don't fit. Here its
subsets are made into states only when a text reaches them. A subset holds, for each guess,
the tokens not emitted yet, the last token and the bytes begun since; what all guesses agree
on is emitted at once. As no token is longer than the vocabulary's longest, guesses that
differ die within so many bytes: the lookahead is bounded.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from elutra.llm.shared import per_batch

#: The white space of Unicode, as the pattern's \s means it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Every match of the pattern that holds white space after other text begins with that white space,
#: so texts can be cut before each run of white space and the parts split on their own.
PARTS = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: A blank within or at the end of a run of white space. Before every other blank a text may be cut as well.
INNER_BLANK = re.compile(f" (?=[{SPACE}]|\\Z)(?<=[{SPACE}] )")
#: How words begin that may stand after an inner blank: with white space, or not at all.
ODD_BEGINS = frozenset(["", *re.findall(f"[{SPACE}]", "".join(map(chr, range(0x3001))))])
#: Words whose ids a task remembers, and a worker that keeps its tables for the tasks to come.
MAX_WORDS, MAX_KEPT = 50_000, 300_000


class Recent:
    """Bytes of strings met lately. When ``most`` are new, those not asked for since the last such time are forgotten."""

    def __init__(self, most: int):
        self.most = most
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def missing(self, asked: set[str]) -> list[str]:
        """Which of ``asked`` aren't held; those that are stay until the next call."""
        if len(self.new) >= self.most:
            self.old, self.new = self.new, {}
        new, old, out = self.new, self.old, []
        for x in asked.difference(new):
            got = old.get(x)
            if got is None:
                out.append(x)
            else:
                new[x] = got
        return out


NEVER = 1 << 40


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Transducer:
    """encode(pieces) for matches of the split pattern.

    A guess is (tokens held back, last token, node of the trie where the bytes begun since stand).
    The guesses of a state are in order of the place where their last token ends; for each
    place there is one guess at most, as the encoding of the bytes before it is unique.
    """

    def __init__(self, ranks: dict[bytes, int], max_states: int = 30_000):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.child: dict[int, int] = {}  # node << 8 | byte -> node; the root is 0
        self.token_at: list[int] = [-1]
        for data, token in ranks.items():
            node = 0
            for byte in data:
                to = self.child.get(node << 8 | byte)
                if to is None:
                    self.child[node << 8 | byte] = to = len(self.token_at)
                    self.token_at.append(-1)
                node = to
            self.token_at[node] = token
        self.goes_on = {key >> 8 for key in self.child}  # nodes that are not the end of every token there
        self.max_states = max_states
        self.edges: dict[int, tuple[list, list] | None] = {}
        self.fits: dict[int, bool] = {}
        self.guesses: list[tuple] = [(((), -1, 0),)]
        self.number = {self.guesses[0]: 0}
        self.next: dict[int, tuple[int, tuple[int, ...]]] = {}  # state << 8 | byte -> state, tokens to emit

    def _merge(self, data: bytes, below: int) -> list[bytes]:
        """The parts of ``data`` once all merges of a rank under ``below`` are made."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _edges(self, token: int) -> tuple[list, list] | None:
        """The token's parts over time at its left and right end, each with the rank that ends it.

        None if merging doesn't lead to this token.
        """
        if token not in self.edges:
            data = self.bytes_of[token]
            parts = self._merge(data, token)
            if len(parts) == 1:
                ends = ([(data, NEVER)], [(data, NEVER)])
            elif len(parts) == 2 and (left := self._edges(self.ranks[parts[0]])) and (right := self._edges(self.ranks[parts[1]])):
                until = lambda side: [(p, min(end, token)) for p, end in side]
                ends = (until(left[0]) + [(data, NEVER)], until(right[1]) + [(data, NEVER)])
            else:
                ends = None
            self.edges[token] = ends
        return self.edges[token]

    def _may_follow(self, last: int, token: int) -> bool:
        """Whether no merge crosses the border between the two: one does if it comes before
        both parts beside the border are merged away from it; of equal ranks the left goes first."""
        own = self._edges(token)
        if own is None or last < 0:
            return own is not None
        key = last << 32 | token
        if key not in self.fits:
            if len(self.fits) > 100_000:
                self.fits.clear()
            ranks, left = self.ranks, self._edges(last)[1]
            self.fits[key] = not any((rank := ranks.get(x + y)) is not None and rank < x_ends and rank <= y_ends for x, x_ends in left for y, y_ends in own[0])
        return self.fits[key]

    def _step(self, guesses: tuple, byte: int) -> tuple[tuple, tuple[int, ...]]:
        """The guesses after ``byte``, and what all of them agree on by then."""
        new, whole = [], None
        child, token_at, goes_on = self.child, self.token_at, self.goes_on
        for held, last, node in guesses:
            node = child.get(node << 8 | byte)
            if node is not None:
                if node in goes_on:
                    new.append((held, last, node))
                token = token_at[node]
                if whole is None and token >= 0 and self._may_follow(last, token):
                    whole = ((*held, token), token, 0)
        new.append(whole)
        first = new[0][0]
        agreed = 0
        while agreed < len(first) and all(len(g[0]) > agreed and g[0][agreed] == first[agreed] for g in new):
            agreed += 1
        return tuple([(held[agreed:], last, node) for held, last, node in new] if agreed else new), first[:agreed]

    def encode(self, pieces: Iterable[bytes]) -> Iterator[list[int]]:
        """Token ids of each piece. Of neighbours that begin alike the common bytes are read once, so sort them.

        Once ``max_states`` are made, further subsets are passed through but not kept.
        """
        ranks, after, number, guesses = self.ranks, self.next, self.number, self.guesses
        before, out = b"", []
        path = [(0, guesses[0], 0)]  # after each byte: state (-1: not kept), guesses, how many tokens are out
        for piece in pieces:
            if (whole := ranks.get(piece)) is not None:  # the library takes such pieces as they are
                yield [whole]
                continue
            n = min(len(before), len(piece))
            differ = int.from_bytes(before[:n]) ^ int.from_bytes(piece[:n])
            n -= (differ.bit_length() + 7) >> 3
            del path[n + 1 :]
            state, here, emitted = path[n]
            del out[emitted:]
            for byte in piece[n:]:
                to = after.get(state << 8 | byte) if state >= 0 else None
                if to is None:
                    here, emit = self._step(here, byte)
                    known = number.get(here, -1)
                    if known < 0 and len(guesses) < self.max_states:
                        number[here] = known = len(guesses)
                        guesses.append(here)
                    if known >= 0 and state >= 0 and len(after) < 2 * self.max_states:
                        after[state << 8 | byte] = (known, emit)
                    state = known
                else:
                    state, emit = to
                    here = guesses[state]
                if emit:
                    out.extend(emit)
                path.append((state, here, len(out)))
            before = piece
            yield out + list(here[-1][0])  # the last guess is the one whose last token ends here


def splitter(pattern: str) -> regex.Pattern:
    """The pattern with white space spelled out, as libraries differ on what \\s is."""
    return regex.compile(pattern.replace(r"\s\p", f"{SPACE}\\p").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))


class Pieces:
    """Ids of parts of texts, from those of the pieces that the pattern splits them into. Pieces met lately are looked up."""

    def __init__(self, transducer: Transducer, pattern: str, most: int = 50_000):
        self.transducer, self.split, self.known = transducer, splitter(pattern).findall, Recent(most)

    def encode(self, parts: list[str]) -> Iterator[bytes]:
        split = [self.split(part) for part in parts]
        unseen = sorted(self.known.missing(set().union(*split)))
        known = self.known.new
        for piece, ids in zip(unseen, self.transducer.encode(map(str.encode, unseen)), strict=True):
            known[piece] = struct.pack(f"<{len(ids)}I", *ids)
        return (b"".join([known[x] for x in own]) for own in split)


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers.

    Texts are cut before blanks. Words met lately are looked up, and the new ones of a batch of texts
    are encoded together by ``of_parts``. In ``words`` a word stands for the blank before it as well;
    what is cut elsewhere stands in ``parts``.
    """

    def __init__(self, of_parts: Callable[[list[str]], Iterable[bytes]], most: int):
        self.of_parts = of_parts
        self.words, self.parts = Recent(most), Recent(most // 4)

    def encode(self, texts: list[str]) -> list[bytes]:
        words = [text.split(" ") for text in texts]
        heads = [[own.pop(0)] for own in words]
        distinct = set().union(*words)
        odd = {x for x in distinct if x[:1] in ODD_BEGINS}
        if odd:
            for k, text in enumerate(texts):
                if not odd.isdisjoint(words[k]) and INNER_BLANK.search(text):
                    heads[k], words[k] = PARTS.findall(text), []
            distinct = set().union(*words)
        for met, asked, before in ((self.parts, set().union(*heads), ""), (self.words, distinct, " ")):
            unseen = met.missing(asked)
            for x, ids in zip(unseen, self.of_parts([before + x for x in unseen]), strict=True):
                met.new[x] = ids
        part, word = self.parts.new.__getitem__, self.words.new.__getitem__
        return [b"".join([*map(part, head), *map(word, own)]) for head, own in zip(heads, words, strict=True)]


#: States of UTF-8: bytes still to come, and the range the next one must lie in.
START = (0, 0x00, 0xFF)


def utf8_step(state: tuple[int, int, int], byte: int) -> tuple[int, int, int] | None:
    """The state after ``byte``; None if no character goes on like that."""
    more, low, high = state
    if more:
        return (more - 1, 0x80, 0xBF) if low <= byte <= high and more > 1 else START if low <= byte <= high else None
    if byte < 0x80:
        return START
    if 0xC2 <= byte <= 0xDF:
        return (1, 0x80, 0xBF)
    if 0xE0 <= byte <= 0xEF:
        return (2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF)
    if 0xF0 <= byte <= 0xF4:
        return (3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF)
    return None


class _From(dict):
    """token -> (text to emit, what follows) for the bytes of a begun character in ``held``."""

    def __init__(self, decoder: StreamDecoder, held: bytes):
        super().__init__()
        self.decoder, self.held = decoder, held

    def __missing__(self, token: int) -> tuple[str, _From]:
        out, begun, state = [], b"", START
        for byte in self.held + self.decoder.bytes_of[token]:
            after = utf8_step(state, byte)
            if after is None:  # a broken character: one mark for what was begun, then this byte anew
                if begun:
                    out.append("�")
                begun, after = b"", utf8_step(START, byte)
                if after is None:
                    out.append("�")
                    state = START
                    continue
            begun += bytes([byte])
            state = after
            if state == START:
                out.append(begun.decode())
                begun = b""
        self[token] = got = ("".join(out), self.decoder.at(begun))
        return got


class StreamDecoder:
    """Text of token ids, emitted as they come; characters cut by token borders wait for their last byte."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of
        self.states: dict[bytes, _From] = {}

    def at(self, held: bytes) -> _From:
        if held not in self.states:
            self.states[held] = _From(self, held)
        return self.states[held]

    def pieces(self, ids: Iterable[int]) -> Iterator[str]:
        state = self.at(b"")
        for i in ids:
            text, state = state[i]
            yield text
        if state.held:
            yield "�"

    def decode(self, ids: Iterable[int]) -> str:
        out, state = [], self.at(b"")
        add = out.append
        for i in ids:
            text, state = state[i]
            add(text)
        if state.held:
            add("�")
        return "".join(out)


def coder(path: str, pattern: str, most: int = MAX_WORDS) -> tuple[Encoder, StreamDecoder]:
    """Made for each task anew: a Python worker that goes on with other work then doesn't hold its tables."""
    transducer = Transducer(read_ranks(path))
    return Encoder(Pieces(transducer, pattern, most).encode, most), StreamDecoder(transducer.bytes_of)


@lru_cache(maxsize=1)
def kept_coder(path: str, pattern: str) -> tuple[Encoder, StreamDecoder]:
    """Made once for a Python worker, with larger tables: its tasks go on with the words of those before."""
    return coder(path, pattern, MAX_KEPT)


#: What ``transcode`` can give, with types.
OUTPUTS = {"n_tokens": "long", "token_ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def transcode(text: Column, path: str, pattern: str, outputs: tuple[str, ...], keep: bool = False) -> Column:
    """A struct of ``outputs`` (names of OUTPUTS) for each text; null counts as empty. ``keep``: workers keep their tables."""

    def make():
        encoder, decoder = (kept_coder if keep else coder)(path, pattern)

        def all_of(texts: list[str]) -> list[tuple]:
            return [result(data) for data in encoder.encode(texts)]

        def result(data: bytes) -> tuple:
            ids = np.frombuffer(data, "<u4")
            decoded = decoder.decode(ids.tolist()) if "decoded" in outputs or "decoded_sha256" in outputs else ""
            got = {
                "n_tokens": lambda: len(ids),
                "token_ids": lambda: ids.astype(np.int32),
                "decoded": lambda: decoded,
                "ids_sha256": lambda: hashlib.sha256(data).hexdigest(),
                "decoded_sha256": lambda: hashlib.sha256(decoded.encode()).hexdigest(),
            }
            return tuple(got[name]() for name in outputs)

        return all_of

    return per_batch(make, ", ".join(f"{n} {OUTPUTS[n]}" for n in outputs), list(outputs))(text)


def encode_and_decode(docs: DataFrame, path: str, pattern: str, outputs: tuple[str, ...] = ("n_tokens", "ids_sha256", "decoded_sha256"), keep: bool = False) -> DataFrame:
    """doc_id and ``outputs`` for every row of ``docs`` (doc_id, text).

    One narrow pass: no shuffle, and tasks hold one batch of texts and tables of bounded size. With
    ``keep`` a Python worker's tasks share them, for jobs in which its memory serves nothing else.
    Null and empty texts have no tokens (and the digests of nothing). Rows are independent:
    repeated rows give repeated results, a null doc_id stays null, other columns are ignored.
    """
    return docs.select("doc_id", transcode(F.col("text"), path, pattern, outputs, keep).alias("x")).select("doc_id", *[f"x.{n}" for n in outputs])
