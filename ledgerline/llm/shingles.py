"""Hashes of words and word sequences of an Arrow batch, in numpy.

Words are runs of ASCII letters and digits and of all characters beyond ASCII,
A-Z folded to lower case. Hashes are 64 bits.
"""

from __future__ import annotations

import numpy as np

MIX1, MIX2, GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0x2545F4914F6CDD1D)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x + GOLD
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


#: per byte: 0 if it ends a word, else a scrambled value; letters A-Z count as a-z
_FOLD = np.arange(256, dtype="u8")
_FOLD[65:91] += np.uint64(32)
_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
BYTE_VALUE = np.where(_WORD, mix(_FOLD + np.uint64(1)), np.uint64(0))


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column (null: empty) with one separator 0 after each text, and the texts' starts."""
    import pyarrow as pa

    rows = [b.as_py() or b"" for b in column.cast(pa.binary())]
    starts = np.concatenate([[0], np.cumsum([len(b) + 1 for b in rows])]).astype("i8")
    return np.frombuffer(b"\0".join([*rows, b""]), "u1"), starts


_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, base: np.uint64) -> np.ndarray:
    """base ** 0 .. n - 1, kept for the next call if not too many."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, "u8")
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 1 << 23:
            _POWERS[int(base)] = have
    return have[:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of values[start:end] for each span, equal for equal spans."""
    sums = np.concatenate([np.zeros(1, "u8"), np.cumsum(values * powers(len(values), BASE), dtype="u8")])
    return mix((sums[ends] - sums[starts]) * powers(len(values) + 1, BASE_INVERSE)[starts] + (ends - starts).astype("u8"))


def words(column) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of the column in order, index of each row's first word; one more at the end)."""
    data, starts = text_bytes(column)
    values = BYTE_VALUE[data]
    inside = np.concatenate([[False], values != 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edges[0::2], edges[1::2]
    return span_hashes(values, begin, end), np.searchsorted(begin, starts)


def shingle_sets(column, size: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its ``size``-word sequences; of fewer words, of all of them together."""
    hashes, first = words(column)
    n = len(hashes)
    grams = np.zeros(n, "u8")
    for j in range(size):
        grams[: n - j] += mix(hashes[j:] ^ np.uint64(j)) * np.uint64(2 * j + 1) if n > j else np.uint64(0)
    grams = mix(grams)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= size:
            out.append(np.unique(grams[a:b - size + 1]))
        elif b > a:
            out.append(mix(np.array([np.bitwise_xor.reduce(mix(hashes[a:b] + np.arange(b - a, dtype="u8"))) + np.uint64(b - a)])))
        else:
            out.append(np.empty(0, "u8"))
    return out
