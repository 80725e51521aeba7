"""Repeats of a minimum length in one block of text, from its Burrows-Wheeler transform.

Rotations are sorted by their first 128 bytes, which is enough for every interval of a
pattern of up to 101 bytes.  Starting with the interval of the empty string, intervals
are extended backwards breadth first; the interval of a pattern of length l that ends
where no boundary is known yet sets one there, whose common prefix is l.  Boundaries
thus appear by increasing common prefix.  The expansion stops at the minimum length:
rows with no boundary between them then share at least that many bytes.
"""

from __future__ import annotations

import numpy as np

#: Ends each string of a block; no UTF-8 text holds this byte.
SEPARATOR = 0xFF


def rotations(text: np.ndarray, depth: int = 128) -> np.ndarray:
    """Starts of all rotations, sorted by their first ``depth`` bytes at least (by doubling)."""
    n = len(text)
    twice = np.concatenate((text, np.resize(text, 8))).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = key << np.uint64(8) | twice[j : j + n]
    order = np.argsort(key)
    key = key[order]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    rank, reach = np.empty(n, np.int64), 8
    while True:
        rank[order] = np.cumsum(new) - 1
        alone = new & np.concatenate((new[1:], [True]))
        tied = np.flatnonzero(~alone)
        if reach >= depth or not len(tied):
            return order
        at = order[tied]
        key = rank[at] * n + rank[(at + reach) % n]  # ties stay where they are, and are parted among themselves
        by = np.argsort(key)
        order[tied], key = at[by], key[by]
        new[tied[1:]] |= key[1:] != key[:-1]
        reach *= 2


def boundaries(text: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """Of n + 1 places between rows: True where the common prefix of the rows around it is shorter than ``least``."""
    n = len(text)
    last = text[order - 1]  # the transform: the byte before each rotation
    by_byte = np.argsort(last, kind="stable")  # row that each row of the first column comes from
    by_byte = by_byte.astype(np.int32)
    step = np.empty(n, np.int32)  # last-to-first mapping
    step[by_byte] = np.arange(n, dtype=np.int32)
    same = np.concatenate((last[by_byte][1:] == last[by_byte][:-1], [False]))
    following, preceding = np.full(n, n, np.int32), np.full(n, -1, np.int32)  # rows with the same last byte
    following[by_byte[:-1][same[:-1]]] = by_byte[1:][same[:-1]]
    preceding[by_byte[1:][same[:-1]]] = by_byte[:-1][same[:-1]]
    known = np.zeros(n + 1, bool)
    known[[0, n]] = True
    low, high = np.array([0], np.int32), np.array([n], np.int32)
    for _ in range(least):
        size = high - low
        rows = np.repeat(low - np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int32), size) + np.arange(size.sum(), dtype=np.int32)
        lows, highs = np.repeat(low, size), np.repeat(high, size)
        start = np.sort(step[rows[preceding[rows] < lows]])
        end = np.sort(step[rows[following[rows] >= highs]]) + 1
        new = ~known[end] | ~known[start]
        low, high = start[new], end[new]
        if not len(low):
            break
        known[low] = known[high] = True
    return known


def later_repeats(strings: list[bytes], least: int) -> list[np.ndarray]:
    """Per string, the starts of its windows of ``least`` bytes that also start earlier: in an earlier string, or before in the same."""
    lens = np.fromiter(map(len, strings), np.int64, len(strings))
    glue = bytes([SEPARATOR])
    text = np.frombuffer(glue.join([*strings, b""]), np.uint8)
    begin = np.concatenate(([0], np.cumsum(lens + 1)[:-1]))
    whole = np.ones(len(text) + 1, np.int64)  # +1 where windows stop fitting, until the next string
    whole[:] = 0
    np.add.at(whole, begin, 1)
    np.add.at(whole, begin + np.maximum(lens - least + 1, 0), -1)
    fits = np.cumsum(whole[:-1]) > 0
    order = rotations(text, least + 28)
    first = np.flatnonzero(boundaries(text, order, least)[:-1])
    inner = fits[order]
    least_of = np.minimum.reduceat(np.where(inner, order, len(text)), first)
    sizes = np.diff(np.concatenate((first, [len(text)])))
    later = np.sort(order[inner & (order > np.repeat(least_of, sizes))])
    cut = np.searchsorted(later, begin)
    return [later[a:b] - s for a, b, s in zip(cut, [*cut[1:], len(later)], begin, strict=True)]
