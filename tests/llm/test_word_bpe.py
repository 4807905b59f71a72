"""BPE with word ends against the tokenizers library."""

from __future__ import annotations

import hashlib
import random
import unicodedata

import pytest
from tokenizers import Tokenizer

from elutra.llm import queries, word_bpe

PATH = queries.tokenizer_file("word_bpe_49k.json")
ODD = ["", " \t\n", "\x00", "a\x1cb c", "<|endoftext|>x<|startoftext|> <|END", "ΣΑΣ Σ ς", "İstanbul ẞ ﬁ", "é ́", "日本語テスト", "🙂🙂👩‍👩‍👧", "don't WE'LL '", "12½²一 3.14", "x" * 3000, "ab" * 2000, "th" * 999 + "e", " 　 z", "..!!??,,"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


def sample(n, seed):
    draw = random.Random(seed)
    pool = [chr(k) for k in range(0x3000) if unicodedata.category(chr(k)) not in ("Cs", "Cn")]
    kinds = (pool, list("aAsStT'eEdDmMlL <|>\n.,!19"), list("theandiro "), ["<|endoftext|>", "x", " ", "'ll", "Ünï"])
    return ["".join(draw.choices(kinds[k % 4], k=draw.randrange(60))) for k in range(n)]


def check(library, coder, texts):
    for text, words in zip(texts, coder.encode(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert [i for w in words for i in memoryview(w[0]).cast("i")] == want, text
        assert " ".join(w[3] for w in words) == library.decode(want, skip_special_tokens=False), text


def test_equals_library(library):
    check(library, word_bpe.Coder(PATH), [*ODD, *sample(4000, 1)])


@pytest.mark.parametrize("many", [1, 1 << 30])
def test_arrays_and_single_places_agree(library, many, monkeypatch):
    """All ranks by array operations, and none."""
    monkeypatch.setattr(word_bpe.PairIndex, "MANY", many)
    check(library, word_bpe.Coder(PATH), [*ODD, *sample(600, 2)])


def test_words_are_forgotten_and_met_again(library, monkeypatch):
    monkeypatch.setattr(word_bpe, "MAX_WORDS", 50)
    monkeypatch.setattr(word_bpe, "TOGETHER", 200)
    check(library, word_bpe.Coder(PATH), sample(1500, 3) * 2)


def test_a_merge_that_makes_an_earlier_pair():
    """Vocabularies may order merges so that a pair of a lower rank appears late; it then comes first in its word."""

    class Small:
        merges = [(0, 4, 5), (2, 0, 6), (0, 1, 4), (1, 0, 7)]
        rank_of = {a << 32 | b: r for r, (a, b, _) in enumerate(merges)}
        byte_ids = last_ids = [0] * 97 + [0, 1, 2] + [0] * 156

    index = word_bpe.PairIndex(Small)
    assert not index.orderly

    def slow(word):
        at = [Small.byte_ids[b] for b in word.encode()]
        while ways := [(r, k) for k in range(len(at) - 1) if (r := Small.rank_of.get(at[k] << 32 | at[k + 1])) is not None]:
            rank, k = min(ways)
            at[k : k + 2] = [Small.merges[rank][2]]
        return at

    draw = random.Random(4)
    words = ["".join(draw.choices("abc", k=draw.randrange(1, 12))) for _ in range(500)]
    ids, ends = index.encode(words)
    assert [ids[s:e].tolist() for s, e in zip([0, *ends[:-1]], ends, strict=True)] == [slow(w) for w in words]


def test_query_columns_on_odd_rows(spark, library, tmp_path):
    rows = [(k, t, "x") for k, t in enumerate(ODD)] + [(None, None, "y"), (3, "again", "z"), (3, "again", "z")]
    spark.createDataFrame(rows, "doc_id long, text string, ids_sha256 string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op13_pair_index_bpe(spark, str(tmp_path)).collect()), key=str)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want, key=str)
    df = spark.createDataFrame(rows[:5], "doc_id long, text string, x string")
    told = word_bpe.encode_and_decode(df, PATH, ("token_ids", "decoded")).collect()
    assert all(library.decode(r["token_ids"], skip_special_tokens=False) == r["decoded"] for r in told)
    assert queries.op13_pair_index_bpe.__name__ in queries.QUERIES and word_bpe.encode_and_decode(df.limit(0), PATH).count() == 0
