"""What the encoders ask of their slow parts, against the libraries."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers as P

from elutra.llm import bpe, token_files


def test_words_around_line_ends_go_to_the_library_together(monkeypatch):
    """A word that holds a line end was a call of its own, and such words are nearly all new."""
    coder, rng, calls = token_files.LibraryEncoder(P.path("byte_bpe_50k.json")), random.Random(1), []
    texts = [f"one{k} end.\nNext{k} word\nlast{k}" for k in range(200)]
    odd = ["".join(rng.choice(["a", " ", "\n", "\r\n", "b.", "\t", "é", "1", "'s", "\n\n", "\x85", "\x1c"]) for _ in range(rng.randrange(30))) for _ in range(2000)]
    want = [e.ids for e in coder.tokenizer.encode_batch_fast(texts + odd, add_special_tokens=False)]
    ids = coder._ids
    monkeypatch.setattr(coder, "_ids", lambda text: calls.append(text) or ids(text))
    got = coder.encode(texts)
    assert len(calls) <= 2
    assert [np.frombuffer(x, "<u4").tolist() for x in got + coder.encode(odd)] == want


def test_a_worker_keeps_its_tables_for_later_tasks(monkeypatch):
    """Each task made the transducer and the table of known words anew. Small tables give the same ids."""
    path, rng, reads, read = P.path("byte_bpe_multi_50k.tiktoken"), random.Random(2), [], bpe.read_ranks
    monkeypatch.setattr(bpe, "read_ranks", lambda x: reads.append(x) or read(x))
    monkeypatch.setattr(bpe, "MAX_KEPT", 50)
    bpe.kept_coder.cache_clear()
    batches = [[" ".join("".join(rng.choice("abté.\n") for _ in range(rng.randrange(7))) for _ in range(80)) for _ in range(5)] for _ in range(12)]
    got = [bpe.kept_coder(path, P.PATTERN)[0].encode(batch) for batch in batches]
    assert len(reads) == 1
    bpe.kept_coder.cache_clear()
    fresh = bpe.coder(path, P.PATTERN)[0]
    assert got == [fresh.encode(batch) for batch in batches]
