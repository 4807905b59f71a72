"""MD5 of many short texts at once, on arrays of 32-bit words."""

from __future__ import annotations

import math

import numpy as np

_ADD = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURN = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_WORD = [*range(16), *((5 * i + 1) % 16 for i in range(16)), *((3 * i + 5) % 16 for i in range(16)), *((7 * i) % 16 for i in range(16))]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _digest(words: list, n: int) -> list[np.ndarray]:
    """The four words of the digests of ``n`` texts of one block each. ``words``: 16 numbers, or arrays where texts differ."""
    a, b, c, d = (np.full(n, v, np.uint32) for v in _START)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        word = words[_WORD[i]]
        if isinstance(word, int):
            f += np.uint32((word + _ADD[i]) & 0xFFFFFFFF)
        else:
            f += word
            f += np.uint32(_ADD[i])
        f += a
        np.right_shift(f, np.uint32(32 - _TURN[i]), out=t)
        f <<= np.uint32(_TURN[i])
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    return [x + np.uint32(v) for x, v in zip((a, b, c, d), _START, strict=True)]


def numbered(prefix: str, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """For the texts ``prefix`` + j, j from ``first`` up to but not ``last``: the first 15 hexadecimal digits of the digests as numbers, and the next 15."""
    high, low = [], []
    while first < last:
        digits = len(str(first))
        end = min(last, 10**digits)
        start = prefix.encode()
        size = len(start) + digits
        if size > 55:
            raise ValueError("texts of up to 55 bytes only")
        text = start + bytes(digits) + b"\x80" + bytes(55 - size) + (8 * size).to_bytes(8, "little")
        words: list = [int.from_bytes(text[k : k + 4], "little") for k in range(0, 64, 4)]
        left = np.arange(first, end, dtype=np.int64)
        for at in range(size - 1, len(start) - 1, -1):
            left, digit = left // 10, left % 10
            words[at // 4] = words[at // 4] + ((digit + 48).astype(np.uint32) << np.uint32(8 * (at % 4)))
        words = [w if isinstance(w, int) else w.astype(np.uint32) for w in words]
        a, b, c, d = (x.byteswap().astype(np.int64) for x in _digest(words, end - first))
        high.append((a << 28) | (b >> 4))
        low.append(((b & 15) << 56) | (c << 24) | (d >> 8))
        first = end
    return np.concatenate(high), np.concatenate(low)
