"""Suffix array of a bounded string by the difference-cover algorithm, in numpy (a helper for one task's piece)."""

from __future__ import annotations

import numpy as np

LIMIT = 1 << 20  # symbols and names fit 20 bits, so that three of them fit a 64-bit key


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``s`` (values 1 .. LIMIT - 1, at most LIMIT - 3 of them) in sorted order."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), "i8")
    t = np.concatenate([s.astype("u8"), np.zeros(3, "u8")])
    # 1. sort the triples at the sampled places, those that are 1 or 2 modulo 3 (a place past the end evens the halves)
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sampled = np.concatenate([ones, twos])
    triples = t[sampled] << np.uint64(40) | t[sampled + 1] << np.uint64(20) | t[sampled + 2]
    order = np.argsort(triples, kind="stable")
    fresh = np.concatenate([[True], triples[order][1:] != triples[order][:-1]])
    names = np.empty(len(sampled), "u8")
    names[order] = np.cumsum(fresh)
    # 2. recurse on the names where they repeat
    if fresh.all():
        in_order = sampled[order]
    else:
        in_order = sampled[suffix_array(names)]
    rank = np.zeros(n + 3, "u8")
    rank[in_order] = np.arange(1, len(in_order) + 1, dtype="u8")
    # 3. sort the other suffixes by first symbol and the rank of the rest, and merge: how many sampled ones come before each
    zeros = np.arange(0, n, 3)
    zeros = zeros[np.argsort(t[zeros] << np.uint64(21) | rank[zeros + 1], kind="stable")]
    from_one, from_two = in_order[in_order % 3 == 1], in_order[in_order % 3 == 2]

    def pair(at):
        return t[at] << np.uint64(21) | rank[at + 1]

    def triple(at):
        return t[at] << np.uint64(41) | t[at + 1] << np.uint64(21) | rank[at + 2]

    before = np.searchsorted(pair(from_one), pair(zeros)) + np.searchsorted(triple(from_two), triple(zeros))
    out = np.empty(len(in_order) + len(zeros), "i8")
    place = before + np.arange(len(zeros))
    taken = np.zeros(len(out), bool)
    taken[place] = True
    out[place], out[~taken] = zeros, in_order
    return out[out < n]


def repeated_windows(text: np.ndarray, size: int) -> np.ndarray:
    """Mask of the places of ``text`` (bytes, 0 only as separator) where ``size`` bytes start that also start elsewhere in it.

    Suffixes that share a prefix are neighbours in the suffix array, so it is
    enough to compare the prefixes of adjacent ones.
    """
    order = suffix_array(text.astype("u8") + np.uint64(1))
    inside = order[order + size <= len(text)]
    padded = np.concatenate([text, np.zeros(8, "u1")])
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    a, b = inside[:-1], inside[1:]
    for at in [*range(0, size - 8, 8), max(size - 8, 0)] if size >= 8 else []:
        if not len(a):
            break
        same = (eight[a + at] == eight[b + at]).all(1)
        a, b = a[same], b[same]
    if size < 8:
        same = (eight[a][:, :size] == eight[b][:, :size]).all(1)
        a, b = a[same], b[same]
    out = np.zeros(len(text), bool)
    out[a] = out[b] = True
    return out
