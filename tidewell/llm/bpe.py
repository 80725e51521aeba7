"""Byte-level BPE by a segment tree over byte positions.

A leaf of the tree holds the merge rank of the pair that starts at its byte
position (infinite where none starts); an inner node holds the smaller child, so
the root is the least rank and walking down, left child first on ties, finds its
leftmost position.  A merge joins the pair there, links its live neighbours and
updates the three leaves it touches: a logarithmic number of nodes each.

Short pieces are merged many at a time, one tree per row of a numpy matrix; long
pieces one at a time in a tree of their own, in O(n log n).

Results equal those of the public library for the same ranks and pattern, special
tokens aside: a null text has no tokens, and special strings are ordinary text.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from public_tokenizers import PATTERN as BY_SPACE
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.caches import bounded, claim

NONE = np.int32(2**31 - 1)
#: Pieces of more bytes than this get a tree of their own.
WIDE = 64
#: Entries a worker's cache of encoded words holds before it starts anew.
CACHE = 500_000
_WS = "[\t-\r \x85\xa0  -     　]"
#: Where white space around a single space makes words depend on their neighbours.
_KNOT = re.compile(f"{_WS} (?:{_WS}|\\Z)")


class PairTable:
    """(left id, right id) -> rank of the joined bytes, as an open-addressing hash table."""

    BITS = 21

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.keys = np.full(1 << self.BITS, -1, np.int64)
        self.vals = np.full(1 << self.BITS, NONE, np.int32)
        if len(left) > 1 << (self.BITS - 1):
            raise ValueError("too many pairs for the table")
        key = left.astype(np.int64) << 24 | right
        slot = self._slot(key)
        while len(key):
            free = self.keys[slot] == -1
            _, first = np.unique(np.where(free, slot, -1), return_index=True)
            first = first[free[first]]
            self.keys[slot[first]], self.vals[slot[first]] = key[first], rank[first]
            rest = np.ones(len(key), bool)
            rest[first] = False
            key, rank, slot = key[rest], rank[rest], slot[rest]
            slot = np.where(self.keys[slot] != -1, (slot + 1) & ((1 << self.BITS) - 1), slot)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 24 | right
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.vals[slot], NONE)
        open_ = np.flatnonzero((found != key) & (found != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.BITS) - 1)
            found = self.keys[slot[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.vals[slot[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece, by a segment tree of its own."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    none, get = int(NONE), ranks.get
    tree = [none] * (2 * size)
    for i in range(n - 1):
        tree[size + i] = get(piece[i : i + 2], none)
    for node in range(size - 1, 0, -1):
        a, b = tree[2 * node], tree[2 * node + 1]
        tree[node] = a if a <= b else b
    after, before = list(range(1, n + 1)), list(range(-1, n))

    def put(at: int, rank: int) -> None:
        node = size + at
        tree[node] = rank
        while node > 1:
            a, b = tree[node], tree[node ^ 1]
            node >>= 1
            least = a if a <= b else b
            if tree[node] == least:
                break
            tree[node] = least

    while tree[1] != none:
        node = 1
        while node < size:
            node *= 2
            if tree[node] > tree[node + 1]:
                node += 1
        i = node - size
        j = after[i]
        k = after[j]
        after[i] = k
        put(j, none) if j < n - 1 else None
        if k < n:
            before[k] = i
            put(i, get(piece[i : after[k]], none))
        else:
            put(i, none)
        if i:
            h = before[i]
            put(h, get(piece[h:k], none))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class ByteBpe:
    """Encoder and decoder for one file of ranks and one split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        #: The published pattern for these vocabularies puts a space with the word after it, so that a text can be taken word by word.
        self.by_space = pattern == BY_SPACE
        self.bytes_of = dict(zip(ranks.values(), ranks.keys(), strict=True))
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(a, b, r) for t, r in ranks.items() for i in range(1, len(t)) if (a := ranks.get(t[:i])) is not None and (b := ranks.get(t[i:])) is not None]
        self.pairs = PairTable(*(np.array(x, np.int64) for x in zip(*pairs, strict=True))) if pairs else PairTable(*[np.zeros(0, np.int64)] * 3)
        self.words: dict[str, bytes] = {}

    # -- merging ---------------------------------------------------------------

    def merge_rows(self, pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after the other, and how many each has. Each is of width bytes at most, a power of two."""
        n, size = len(pieces), width
        lens = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        ids = self.byte_id[raw].astype(np.int32)
        spot = np.arange(width)
        after = np.broadcast_to(spot + 1, (n, width)).astype(np.int32).ravel()
        before = np.broadcast_to(spot - 1, (n, width)).astype(np.int32).ravel()
        alive = spot < lens[:, None]
        tree = np.full((n, 2 * size), NONE, np.int32)
        if width > 1:
            pair = self.pairs.get(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
            tree[:, size : size + width - 1] = np.where(spot[:-1] < (lens - 1)[:, None], pair, NONE)
        half = size
        while half > 1:
            tree[:, half // 2 : half] = np.minimum(tree[:, half : 2 * half : 2], tree[:, half + 1 : 2 * half : 2])
            half //= 2
        tree, ids = tree.ravel(), ids.ravel()
        flat_alive = alive.ravel()
        act = np.flatnonzero(tree[1 :: 2 * size] != NONE)
        while len(act):
            base, own, end = act * (2 * size), act * width, lens[act]
            node = np.ones(len(act), np.int64)
            while node[0] < size:
                node *= 2
                node += tree[base + node] > tree[base + node + 1]
            i = node - size
            rank = tree[base + node]
            j = after[own + i].astype(np.int64)
            k = after[own + j].astype(np.int64)
            ids[own + i] = rank
            after[own + i] = k
            flat_alive[own + j] = False
            has = k < end
            before[(own + k)[has]] = i[has]
            right = np.full(len(act), NONE, np.int32)
            right[has] = self.pairs.get(rank[has], ids[(own + k)[has]])
            h = before[own + i].astype(np.int64)
            back = h >= 0
            left = np.full(len(act), NONE, np.int32)
            left[back] = self.pairs.get(ids[(own + h)[back]], rank[back])
            self._put(tree, base, size, j, NONE)
            self._put(tree, base, size, i, right)
            self._put(tree, base[back], size, h[back], left[back])
            act = act[tree[base + 1] != NONE]
        return ids[flat_alive], alive.sum(axis=1)

    @staticmethod
    def _put(tree: np.ndarray, base: np.ndarray, size: int, at: np.ndarray, rank) -> None:
        node = at + size
        tree[base + node] = rank
        while size > 1:
            size //= 2
            node >>= 1
            tree[base + node] = np.minimum(tree[base + 2 * node], tree[base + 2 * node + 1])

    def encode_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """piece -> its ids as int32 bytes, for distinct pieces of the pattern."""
        out: dict[str, bytes] = {}
        todo: dict[int, tuple[list[str], list[bytes]]] = {}
        whole = self.ranks.get
        for p in pieces:
            b = p.encode()
            rank = whole(b)
            if rank is not None:
                out[p] = rank.to_bytes(4, "little")
            elif len(b) > WIDE:
                out[p] = np.array(merge_long(b, self.ranks), "<i4").tobytes()
            else:
                names, rows = todo.setdefault(max(2, 1 << (len(b) - 1).bit_length()), ([], []))
                names.append(p)
                rows.append(b)
        for width, (names, rows) in todo.items():
            for at in range(0, len(rows), 20_000):
                ids, counts = self.merge_rows(rows[at : at + 20_000], width)
                data = ids.astype("<i4").tobytes()
                ends = (4 * np.cumsum(counts)).tolist()
                out.update(zip(names[at : at + 20_000], map(data.__getitem__, map(slice, [0, *ends], ends)), strict=True))
        return out

    # -- texts -----------------------------------------------------------------

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as int32 bytes.

        With the pattern BY_SPACE a text is taken word by word, each with the space before
        it, from a bounded cache, unless white space ties words together.  Else the pattern
        splits it as a whole.
        """
        if len(self.words) > CACHE:
            self.words.clear()
        words, split = self.words, self._split
        plan, new, loose = [], set(), set()
        for t in texts:
            if not t:
                plan.append(((), ()))
                continue
            if not self.by_space or _KNOT.search(t):
                head, tail = split(t), ()
            else:
                first, *tail = t.split(" ")
                head = split(first)
            loose.update(head)
            new.update(set(tail).difference(words))
            plan.append((head, tail))
        plain = [w for w in new if w.isalpha() and max(w) < "\u0250"]
        rest = {w: split(" " + w) for w in new.difference(plain)}
        loose.update(chain.from_iterable(rest.values()))
        loose.update([" " + w for w in plain])
        ids = self.encode_pieces(list(loose))
        get = ids.__getitem__
        words.update({w: get(" " + w) for w in plain})
        words.update({w: b"".join(map(get, pieces)) for w, pieces in rest.items()})
        of = words.__getitem__
        return [b"".join(chain(map(get, head), map(of, tail))) for head, tail in plan]

    def _split(self, text: str) -> list[str]:
        """The pattern's matches."""
        return [m.group() for m in self.pattern.finditer(text)] if self.pattern.groups else self.pattern.findall(text)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_many([text])[0], "<i4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> ByteBpe:
    """The encoder of this process for a rank file; every node has the file at that path."""
    return ByteBpe(read_ranks(path), pattern)


def _groups(batch: pa.RecordBatch, column: int, most: int = 4_000_000, rows: int = 512) -> Iterator[tuple[int, list]]:
    """(first row, texts) in groups of bounded size, so that a batch of long texts is not held in full."""
    col = batch.column(column)
    at, some, size = 0, [], 0
    for i in range(len(col)):
        t = col[i].as_py()
        some.append(t)
        size += len(t or "")
        if size >= most or len(some) >= rows:
            yield at, some
            at, some, size = i + 1, [], 0
    if some:
        yield at, some


def encode_decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, ids (array<int>) and decoded (binary): each text encoded, and its ids decoded again.

    One row per input row. A null text counts as empty: no ids and no bytes. Repeated
    rows give repeated results; a null id stays null; other columns are not read.  A
    text and its ids are held whole by the task that encodes it.
    """
    some = df.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("__text"))

    def run(batches):
        claim(f"bpe {path}", encoder.cache_clear)
        bpe = encoder(path, pattern)
        for batch in batches:
            for at, texts in _groups(batch, 1):
                rows = bpe.encode_many(texts)
                offsets = np.zeros(len(rows) + 1, np.int32)
                np.cumsum([len(x) // 4 for x in rows], out=offsets[1:])
                flat = np.frombuffer(b"".join(rows), "<i4")
                decoded = [bpe.decode(np.frombuffer(x, "<i4").tolist()) for x in rows]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(rows)), pa.ListArray.from_arrays(offsets, flat), pa.array(decoded, pa.binary())], [id_col, "ids", "decoded"])

    kind = some.schema[0].dataType.simpleString()
    return bounded(some).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded binary")


def count_tokens(df: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """n_tokens (long), one row per input row, repeated rows included; a null text has none. No other column is read."""

    def run(batches):
        claim(f"bpe {path}", encoder.cache_clear)
        bpe = encoder(path, pattern)
        for batch in batches:
            for _, texts in _groups(batch, 0):
                counts = [len(x) // 4 for x in bpe.encode_many(texts)]
                yield pa.RecordBatch.from_arrays([pa.array(counts, pa.int64())], ["n_tokens"])

    return bounded(df.select(F.col(text_col).cast("string").alias("__text"))).mapInArrow(run, "n_tokens long")
