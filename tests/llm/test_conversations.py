"""Repair of conversations against an enumeration of all edits, whole and in pieces."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from elutra.llm import conversations as c

SPACE = " \t\n\x0b\x0c\r"


def faults(rows):
    """Of rows (role, text): blank, duplicate, truncated or None."""
    out, seen = [], set()
    for role, text in rows:
        bare = text.strip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else None if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, put out) over all edits with at most two rows put in at a place."""
    told, best = faults(rows), []

    def go(k, cost, audit, out, put_in):
        initials = "".join(x[0] for x in out)
        if cost > 4 * len(rows) or not re.fullmatch("(s?(ua)*u?)?", initials):  # all rows may go
            return
        if k == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            best.append((cost, audit, out))
        if put_in < 2:
            for role in ("user", "assistant"):
                go(k, cost + 3, audit + "I", (*out, f"{role}:"), put_in + 1)
        if k == len(rows):
            return
        (role, text), fault = rows[k], told[k]
        go(k + 1, cost + 4, audit + "D", out, 0)
        if fault not in ("blank", "duplicate"):
            late = 3 * (fault == "truncated")
            if role[:1] in ("s", "u", "a"):
                go(k + 1, cost + late, audit + "K", (*out, f"{role}:{text}"), 0)
            for new in ("user", "assistant"):
                go(k + 1, cost + 3 + late, audit + "R", (*out, f"{new}:{text}"), 0)

    go(0, 0, "", (), 0)
    return min(best)


def expected(rows):
    """The contract's columns for rows (turn, role, text) in order."""
    told = faults([r[1:] for r in rows])
    turns = [r[0] for r in rows if r[0] is not None]
    initials = [r[1][:1] for r in rows]
    cost, audit, out = cheapest([r[1:] for r in rows])
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        **{f: told.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(out).encode()).hexdigest(),
    }


def damaged(rows):
    """Rows (conv_id, turn, role, text) by conversation, as the damage leaves them."""
    out = {}
    for conv, turn, role, text in rows:
        told = lambda x: " " if x is None else str(x)
        kept = out.setdefault(conv, [])
        kind = zlib.crc32(f"{told(conv)}:{told(turn)}".encode()) % 20
        role, text = "user" if kind == 4 else told(role), "" if kind == 1 else told(text)
        text = re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {k: sorted(v, key=lambda r: (r[0] is not None, r[0], r[1], r[2])) for k, v in out.items()}


SCHEMA = "conv_id long, turn long, role string, text string"
ROLES = ["user", "assistant", "system", "tool", "", None, "unknown", "User"]
TEXTS = ["Fine.", "Well?", "no end", " ", "", None, "Oh! \n", "ends.\x0b", "ünï", ".", " "]


def sample(n, most, seed):
    draw = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(draw.randrange(1, most + 1)):
            rows.append((conv, draw.choice([turn, turn, turn, turn + 3, None]), draw.choice(ROLES[:2] * 4 + ROLES), draw.choice(TEXTS[:2] * 4 + TEXTS)))
    rows += [(None, k, draw.choice(ROLES[:3]), draw.choice(TEXTS)) for k in range(4)]
    return rows


@pytest.mark.parametrize("most_rows", [c.ROWS, 2])
def test_equals_enumeration(spark, most_rows):
    """With pieces of two rows as well, and rows of equal turn, null turns and null ids."""
    rows = sample(80, 3, 1)
    got = c.repair(c.damaged(spark.createDataFrame(rows, SCHEMA)), most_rows=most_rows).collect()
    want = damaged(rows)
    assert len(got) == len(want) and {r["conv_id"] for r in got} == set(want)
    for r in got:
        own = r.asDict()
        assert own == {"conv_id": r["conv_id"], **expected(want[r["conv_id"]])}


def test_pieces_equal_wholes_on_long_conversations(spark):
    draw = random.Random(5)
    rows = [(conv, t, draw.choice(ROLES[:2] * 9 + ROLES[:4]), draw.choice([f"t{draw.randrange(400)}.", *TEXTS])) for conv in range(3) for t in range(700)]
    df = c.damaged(spark.createDataFrame(rows, SCHEMA))
    whole = sorted(map(tuple, c.repair(df, with_text=True).collect()))
    assert sorted(map(tuple, c.repair(df, with_text=True, most_rows=64).collect())) == whole
    assert sorted(map(tuple, c.repair(df, with_text=True, most_bytes=500).collect())) == whole
    assert all(hashlib.sha256(r[-1].encode()).hexdigest() == r[-2] for r in whole)


def test_one_conversation_of_equal_rows_in_pieces(spark):
    """All rows alike: one stays, the others are duplicates."""
    rows = [(7, None, "user", "Same.")] * 300 + [(7, None, "assistant", "Yes.")]
    got = c.repair(c.damaged(spark.createDataFrame(rows, SCHEMA)), most_rows=50).collect()
    assert len(got) == 1
    kind = zlib.crc32(b"7: ") % 20
    n = {0: 0, 3: 602}.get(kind, 301)
    assert len(got[0]["audit"].replace("I", "")) == n


def test_odd_tables(spark):
    assert c.repair(c.damaged(spark.createDataFrame([], SCHEMA))).count() == 0
    lost = next(k for k in range(10_000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(lost, 0, "user", "Hi.", 1, True, "x")], f"{SCHEMA}, copy int, dropped boolean, fault string")
    for most in (c.ROWS, 0):
        (r,) = c.repair(c.damaged(df), most_rows=most).collect()
        assert tuple(r) == (lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    long = spark.createDataFrame([(1, 2, "user", "word " * 400_000), (1, 3, "assistant", "Yes.")], SCHEMA)
    a, b = (c.repair(c.damaged(long), most_bytes=most).collect() for most in (1 << 30, 1000))
    assert a == b and len(a) == 1


def test_grammar_gives_what_letters_give():
    draw = random.Random(3)
    words = ["".join(draw.choices("suaUAox", [1, 8, 8, 1, 1, 1, 1], k=draw.randrange(60))) for _ in range(300)]
    plain, compressed = c.Grammar(words, least=1 << 40), c.Grammar(words, least=2)
    assert len(plain.symbols) == len(c.LETTERS) < len(compressed.symbols)
    assert all(plain.repaired(w) == compressed.repaired(w) for w in words)
    whole = [w for w in words if w]
    assert all(c.path([(s.costs, s.order)])[0] == plain.repaired(w)[0] for w in whole for s in [compressed.whole(w)])
