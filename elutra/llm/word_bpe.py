"""BPE with word ends by an index of pair occurrences, for tokenizer files of lower-casing word vocabularies.

The new words of a batch are laid out one after another. An index maps the rank of each mergeable
pair to all places where it stands. The active ranks are applied in ascending order, each at all
its places from left to right; every merge looks up the two pairs that it makes and adds their
places to the index. Words don't touch each other, so this gives each word what merging it alone
would, while a rank is looked up once for the whole batch.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from elutra.llm.shared import per_batch

#: Words met lately that a task keeps, and characters of text that are laid out together.
MAX_WORDS, TOGETHER = 100_000, 4_000_000
#: Beyond these letters and signs, versions of Unicode differ in what composes, what has a lower case and what is a letter;
#: there the tokenizer file's own normalizer and splitter decide.
UNSETTLED = re.compile("[^\t-\r\x20-\x7e\xa0-\u02ff\u0370-\u0482\u048a-\u0556\u2010-\u2027\u2030-\u205e\u3001-\u3029\u3030-\u3096\u30a1-\u30fe\u4e00-\u9fa5\uac00-\ud7a3]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a vocabulary: itself if it is printable Latin-1, else one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(others)) for b in range(256)]


class Vocabulary:
    """What a tokenizer file says: token ids, merges by rank, the pattern of words, and whole tokens that texts may hold."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model = told["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.id_of: dict[str, int] = model["vocab"]
        added = {x["content"]: x["id"] for x in told["added_tokens"]}
        self.token_of = {i: t for t, i in (self.id_of | added).items()}
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        #: By rank: both parts and what they become.
        self.merges = [(self.id_of[a], self.id_of[b], self.id_of[a + b]) for a, b in pairs]
        self.rank_of = {a << 32 | b: rank for rank, (a, b, _) in reversed(list(enumerate(self.merges)))}
        letters = byte_letters()
        self.byte_ids = [self.id_of[x] for x in letters]
        self.last_ids = [self.id_of[x + self.end] for x in letters]
        split = told["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # The files' engine takes white space for what Unicode calls so.
        self.words = regex.compile(split.replace(r"\s", r"\p{White_Space}")).findall
        self.whole = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.added = added
        #: The file's normalizer and splitter, without its model.
        self.library = Tokenizer.from_str(json.dumps(told | {"added_tokens": [], "model": {"type": "BPE", "vocab": {}, "merges": []}}))

    def split(self, text: str) -> list[str]:
        """Words of a text without whole tokens."""
        if UNSETTLED.search(text) is None:
            return self.words(normal(text))
        text = self.library.normalizer.normalize_str(text)
        return [text[s:e] for _, (s, e) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def pieces(self, text: str) -> list[str]:
        """Words of a text in order, and the whole tokens in it, which are looked for before it is normalized."""
        if self.whole is None or "<" not in text:
            return self.split(text)
        out: list[str] = []
        for k, part in enumerate(self.whole.split(text)):
            if k % 2:
                out.append(part)
            elif part:
                out += self.split(part)
        return out


def normal(text: str) -> str:
    """Composed, and every character lower-cased by itself (a final sigma is not told apart)."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


class PairIndex:
    """Encodes many words at once."""

    #: From so many places on a rank is applied to all of them by array operations.
    MANY = 64

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.codes = np.array(sorted(vocabulary.rank_of), np.int64)
        self.ranks = np.array([vocabulary.rank_of[c] for c in self.codes.tolist()], np.int64)
        made = {new: rank for rank, (_, _, new) in enumerate(vocabulary.merges)}
        #: Whether no merge can make a pair of a lower rank than its own: then the order within a rank doesn't matter.
        self.orderly = all(max(made.get(a, -1), made.get(b, -1)) < rank for rank, (a, b, _) in enumerate(vocabulary.merges))

    def by_rank(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each rank of the pairs (left, right) with the places ``at`` of its pairs."""
        if not len(at):
            return
        codes = left.astype(np.int64) << 32 | right
        k = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        known = self.codes[k] == codes
        ranks, at = self.ranks[k[known]], at[known]
        order = np.argsort(ranks, kind="stable")
        ranks, at = ranks[order], at[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        for first, places in zip([0, *cuts.tolist()], np.split(at, cuts), strict=True):
            if len(places):
                yield int(ranks[first]), places

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words one after another, and where each word's end."""
        v = self.vocabulary
        rank_of, merges = v.rank_of, v.merges
        if not words:
            return np.array([], np.int32), np.array([], np.int64)
        data = [w.encode() for w in words]
        sizes = np.array([len(d) for d in data])
        ends = np.cumsum(sizes)
        all_bytes = np.frombuffer(b"".join(data), np.uint8)
        n = len(all_bytes)
        laid = np.array(v.byte_ids, np.int32)[all_bytes]
        laid[ends - 1] = np.array(v.last_ids, np.int32)[all_bytes[ends - 1]]
        next_of, last_of = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        next_of[ends - 1] = -1
        last_of[ends - sizes] = -1
        # Single places are reached through arrays, many at once through numpy's views of the same memory.
        symbols, after, before = (array("i", x.tobytes()) for x in (laid, next_of, last_of))
        of, to, fro = (np.frombuffer(x, np.int32) for x in (symbols, after, before))
        places: dict[int, list[int]] = {}
        at = np.flatnonzero(to >= 0)
        for rank, found_at in self.by_rank(of[at], of[to[at]], at):
            places[rank] = found_at.tolist()
        active = list(places)
        heapq.heapify(active)

        def found(rank: int, at: list[int]) -> None:
            if (known := places.get(rank)) is None:
                places[rank] = at
                heapq.heappush(active, rank)
            else:
                known += at

        while active:
            rank = heapq.heappop(active)
            a, b, new = merges[rank]
            waiting = places.pop(rank)
            if len(waiting) >= self.MANY and a != b and self.orderly:
                i = np.sort(np.array(waiting, np.int32))
                i = i[np.diff(i, prepend=-1) > 0]
                j = to[i]
                fits = (of[i] == a) & (j >= 0) & (of[j] == b)  # else a merge since then has taken one of them
                i, j = i[fits], j[fits]
                right = to[j]
                of[i], of[j], to[i] = new, -1, right
                some = right >= 0
                fro[right[some]] = i[some]
                left = fro[i]
                first = left >= 0
                pairs = (np.concatenate(x) for x in ((of[i[some]], of[left[first]]), (of[right[some]], of[i[first]]), (i[some], left[first])))
                for other, found_at in self.by_rank(*pairs):
                    found(other, found_at.tolist())
                continue
            waiting.sort()
            for k, i in enumerate(waiting):
                j = after[i]
                if symbols[i] != a or j < 0 or symbols[j] != b:
                    continue
                symbols[i], symbols[j] = new, -1
                after[i] = right = after[j]
                least = rank
                if right >= 0:
                    before[right] = i
                    if (r := rank_of.get(new << 32 | symbols[right])) is not None:
                        found(r, [i])
                        least = min(least, r)
                if (left := before[i]) >= 0 and (r := rank_of.get(symbols[left] << 32 | new)) is not None:
                    found(r, [left])
                    least = min(least, r)
                if least < rank and k + 1 < len(waiting):  # a rank before this one has become active: it comes first
                    found(rank, waiting[k + 1 :])
                    break
        left_over = of >= 0
        return of[left_over], np.cumsum(left_over)[ends - 1]


def decode(vocabulary: Vocabulary, ids: list[int]) -> str:
    """The tokens' own text with a space between them: these files name no decoder that would join them. Unknown ids give nothing."""
    of = vocabulary.token_of
    return " ".join([of[i] for i in ids if i in of])


class Lately(dict):
    """What was met lately: once ``most`` entries are new, those that were not asked for since the last time go."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most, {}

    def missing(self, keys: set[str]) -> list[str]:
        """Those of ``keys`` that are not kept. The others are counted as new, and stay until the next call."""
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
        new = keys.difference(self)
        back = new.intersection(self.old)
        self.update((key, self.old[key]) for key in back)
        return list(new.difference(back))


class Coder:
    """Encodes texts. What stands between white space is looked up whole; words and whole stretches met lately are kept."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.index = PairIndex(self.vocabulary)
        self.told = {i: str(i) for i in self.vocabulary.token_of}
        self.words, self.stretches = Lately(MAX_WORDS), Lately(MAX_WORDS)

    def split(self, text: str) -> list[str]:
        """The stretches of a text. Words never reach over white space, so each can be read by itself."""
        v = self.vocabulary
        if (v.whole is not None and "<" in text) or UNSETTLED.search(text):
            return v.pieces(text)
        return normal(text).split()

    def parts(self, stretch: str) -> list[str]:
        """The words of a stretch. Letters only, or letters and a mark behind, need no pattern."""
        if stretch.isalpha():
            return [stretch]
        if stretch[-1] in ",.;:!?" and stretch[:-1].isalpha():
            return [stretch[:-1], stretch[-1]]
        if stretch in self.vocabulary.added or UNSETTLED.search(stretch):  # the latter only as words of a text that was split before
            return [stretch]
        return self.vocabulary.words(stretch)

    def learn(self, stretches: set[str]) -> None:
        """Makes ``stretches`` hold at least these: their ids, and ids and tokens as text."""
        v = self.vocabulary
        new = self.stretches.missing(stretches)
        parts = [self.parts(x) for x in new]
        words = self.words.missing(set().union(*parts))
        self.words.update(zip(whole := [w for w in words if w in v.added], self.entries(np.array([v.added[w] for w in whole], np.int32), np.arange(1, len(whole) + 1)), strict=True))
        plain = [w for w in words if w not in v.added]
        self.words.update(zip(plain, self.entries(*self.index.encode(plain)), strict=True))
        of = self.words
        for stretch, own in zip(new, parts, strict=True):
            if len(own) == 1:
                self.stretches[stretch] = of[own[0]]
            elif len(own) == 2:
                (ids, n, told, tokens), last = of[own[0]], of[own[1]]
                self.stretches[stretch] = ids + last[0], n + last[1], f"{told} {last[2]}", f"{tokens} {last[3]}"
            else:
                ids, n, told, tokens = zip(*[of[w] for w in own], strict=True)
                self.stretches[stretch] = b"".join(ids), sum(n), " ".join(told), " ".join(tokens)

    def entries(self, ids: np.ndarray, ends: np.ndarray) -> Iterator[tuple[bytes, int, str, str]]:
        """For each of several runs of ids: its bytes, their number, the ids as text, and what they decode to."""
        data, ends, start = ids.tobytes(), ends.tolist(), 0
        ids = ids.tolist()
        told = [self.told[i] for i in ids]
        for end in ends:
            yield data[4 * start : 4 * end], end - start, " ".join(told[start:end]), decode(self.vocabulary, ids[start:end])
            start = end

    def encode(self, texts: list[str]) -> Iterator[list[tuple[bytes, int, str, str]]]:
        """Of each text what ``stretches`` holds for it, in order; texts are read ``TOGETHER`` characters at a time."""
        at = 0
        while at < len(texts):
            until, size = at, 0
            while until < len(texts) and (until == at or size + len(texts[until]) <= TOGETHER):
                size += len(texts[until])
                until += 1
            split = [self.split(x) for x in texts[at:until]]
            self.learn(set().union(*split))
            known = self.stretches.__getitem__
            for stretches in split:
                yield list(map(known, stretches))
            at = until


#: What ``transcode`` can give, with types.
OUTPUTS = {"n_tokens": "long", "token_ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def transcode(text: Column, path: str, outputs: tuple[str, ...]) -> Column:
    """A struct of ``outputs`` (names of OUTPUTS) for each text; null counts as empty."""

    def make():
        coder = Coder(path)

        def result(words: list[tuple[bytes, int, str, str]]) -> tuple:
            ids, n, told, tokens = zip(*words, strict=True) if words else ((),) * 4
            got = {
                "n_tokens": lambda: sum(n),
                "token_ids": lambda: np.frombuffer(b"".join(ids), np.int32),
                "decoded": lambda: " ".join(tokens),
                "ids_sha256": lambda: hashlib.sha256(" ".join(told).encode()).hexdigest(),
                "decoded_sha256": lambda: hashlib.sha256(" ".join(tokens).encode()).hexdigest(),
            }
            return tuple(got[name]() for name in outputs)

        return lambda texts: [result(words) for words in coder.encode(texts)]

    return per_batch(make, ", ".join(f"{n} {OUTPUTS[n]}" for n in outputs), list(outputs))(text)


def encode_and_decode(docs: DataFrame, path: str, outputs: tuple[str, ...] = ("n_tokens", "ids_sha256", "decoded_sha256")) -> DataFrame:
    """doc_id and ``outputs`` for every row of ``docs`` (doc_id, text).

    One narrow pass: no shuffle; tasks hold a batch of texts and a bounded table of words. Null, empty
    and blank texts have no tokens. Special tokens that stand in a text are taken for themselves. Rows are
    independent: repeated rows give repeated results, a null doc_id stays null, other columns are ignored.
    """
    return docs.select("doc_id", transcode(F.col("text"), path, outputs).alias("x")).select("doc_id", *[f"x.{n}" for n in outputs])
