"""Benchmark decontamination against a broadcast hash set of normalised test n-grams.

Texts are lower-cased in A-Z only and split into words of digits, letters and anything
beyond ASCII.  A benchmark item is its windows of ``n`` consecutive words, or one
window of all its words if it has fewer.  Documents are scanned window by window: a
rolling hash of word ids proposes, comparing the ids verifies.  A document word in any
occurrence of a window is hit; a document is contaminated if at least one in
``one_in`` of its words is.

A hash set holds the windows of ``MAX_SET_WORDS`` words of items at most, which bounds
what is broadcast (some 60 MB, 130 if no word comes twice) and what the driver holds.  A
larger benchmark is dealt out to several sets, broadcast one after the other; the hits
of each are written, and merged by the texts' digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.caches import bounded, claim
from tidewell.llm.names import fresh
from tidewell.llm.store import Scratch

#: Words of items whose windows are broadcast at once.
MAX_SET_WORDS = 1_000_000
_DROP = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_BASE = 6364136223846793005
_SPANS = "array<struct<`from`:int,`to`:int>>"


def words(text: str | None) -> list[bytes]:
    """Words of the normalised text; a null text has none."""
    return text.encode().lower().translate(_DROP).split() if text else []


class _Rolling:
    """Hashes of all windows of a sequence of word ids, each from two prefix sums."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def sums(self, ids: np.ndarray) -> np.ndarray:
        if len(ids) > len(self.up):
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                powers = np.full(len(ids), base, np.uint64)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))
        value = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(31)
        total = np.zeros(len(ids) + 1, np.uint64)
        np.cumsum(value * self.up[: len(ids)], out=total[1:])
        return total

    def at(self, total: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        h = (total[starts + size] - total[starts]) * self.down[starts]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ h >> np.uint64(32)


class _Table:
    """Hash -> place of its first window, by open addressing."""

    def __init__(self, hashes: np.ndarray, places: np.ndarray):
        bits = max(4, int(2 * len(hashes)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.places = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        slot = (hashes >> self.shift).astype(np.int64)
        while len(hashes):
            free = np.flatnonzero(self.places[slot] < 0)
            own = free[np.unique(slot[free], return_index=True)[1]]  # one for each free slot
            self.keys[slot[own]], self.places[slot[own]] = hashes[own], places[own]
            rest = np.ones(len(hashes), bool)
            rest[own] = False
            hashes, places, slot = hashes[rest], places[rest], slot[rest]
            slot = np.where(self.places[slot] >= 0, slot + 1 & self.mask, slot)

    def get(self, hashes: np.ndarray) -> np.ndarray:
        """Places, -1 where a hash is not in the set."""
        out, todo, slot = np.full(len(hashes), -1, np.int64), np.arange(len(hashes)), (hashes >> self.shift).astype(np.int64)
        while len(todo):
            found, place = self.keys[slot] == hashes[todo], self.places[slot]
            hit = found & (place >= 0)
            out[todo[hit]] = place[hit]
            on = ~hit & (place >= 0)
            todo, slot = todo[on], slot[on] + 1 & self.mask
        return out


class _Windows:
    """Distinct windows of one length: sorted hashes, where each stands in the items' words, and its owners."""

    def __init__(self, flat: np.ndarray, starts: np.ndarray, owners: np.ndarray, hashes: np.ndarray, size: int):
        order = np.lexsort((owners, hashes))
        h, starts, owners = hashes[order], starts[order], owners[order]
        spot = np.arange(size)
        same = h[1:] == h[:-1]
        for i in np.flatnonzero(same).tolist():  # equal hashes are equal windows, but for collisions
            same[i] = np.array_equal(flat[starts[i] + spot], flat[starts[i + 1] + spot])
        first = np.flatnonzero(np.concatenate(([True], ~same)))
        self.hashes, self.starts, self.size = h[first], starts[first].astype(np.int32), size
        self.owners, self.ends = owners.astype(np.int32), np.concatenate((first, [len(h)]))
        lead = np.flatnonzero(np.concatenate(([True], self.hashes[1:] != self.hashes[:-1])))
        self.table = _Table(self.hashes[lead], lead.astype(np.int32))

    def owned(self, places: np.ndarray) -> np.ndarray:
        return np.unique(np.concatenate([self.owners[self.ends[p] : self.ends[p + 1]] for p in places.tolist()]))


class WindowSet:
    """Hash set of the windows of items (name, window length, words)."""

    def __init__(self, items: list[tuple[object, int, list[bytes]]]):
        self.vocab: dict[bytes, int] = {}
        self.names, self.by_size, self.rolling = [x[0] for x in items], [], _Rolling()
        put = self.vocab.setdefault
        self.flat = np.array([put(w, len(self.vocab) + 1) for _, _, ws in items for w in ws], np.int32)
        total = self.rolling.sums(self.flat)
        lens, sizes = (np.array([f(x) for x in items], np.int64) for f in (lambda x: len(x[2]), lambda x: x[1]))
        begin = np.cumsum(lens) - lens
        for size in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == size)
            many = lens[own] - size + 1
            owners = np.repeat(own, many)
            starts = np.repeat(begin[own] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            self.by_size.append(_Windows(self.flat, starts, owners, self.rolling.at(total, starts, size), size))
        self.rolling = _Rolling()  # its powers grow again where it is used

    def forget(self) -> None:
        self.rolling = _Rolling()

    def scan(self, doc: list[bytes]) -> tuple[np.ndarray, list[int]]:
        """Which words are hit, and the places in ``names`` of the items with occurring windows."""
        hit, items = np.zeros(len(doc) + 1, np.int64), []
        ids = np.fromiter(map(self.vocab.get, doc, [0] * len(doc)), np.int64, len(doc))
        known, total = np.concatenate(([0], np.cumsum(ids > 0))), None
        for own in self.by_size:
            at = np.flatnonzero(known[own.size :] - known[: -own.size] == own.size)
            if not len(at):
                continue
            total = self.rolling.sums(ids) if total is None else total
            hashes = self.rolling.at(total, at, own.size)
            place = own.table.get(hashes)
            at, place, hashes = at[place >= 0], place[place >= 0], hashes[place >= 0]
            spot = np.arange(own.size)
            while len(at):
                equal = (self.flat[own.starts[place][:, None] + spot] == ids[at[:, None] + spot]).all(axis=1)
                np.add.at(hit, at[equal], 1)
                np.add.at(hit, at[equal] + own.size, -1)
                if equal.any():
                    items.append(own.owned(np.unique(place[equal])))
                # a window of the same hash may be another one
                at, place, hashes = at[~equal], place[~equal] + 1, hashes[~equal]
                on = place < len(own.hashes)
                on[on] = own.hashes[place[on]] == hashes[on]
                at, place, hashes = at[on], place[on], hashes[on]
        return np.cumsum(hit)[:-1] > 0, np.unique(np.concatenate(items)).tolist() if items else []


def _blocks(benchmark: DataFrame, n: int, id_col: str, text_col: str, most: int) -> Iterator[list[tuple[object, int, list[bytes]]]]:
    """Items with their words, in blocks of ``most`` words or about; a longer item is parted into overlapping ones. Items without words are left out."""
    block, held = [], 0
    for name, text in benchmark.select(F.col(id_col), F.col(text_col).cast("string")).where(F.col(text_col).isNotNull()).toLocalIterator():
        all_words = words(text)
        size = min(n, len(all_words))
        for at in range(0, len(all_words) - size + 1 if size else 0, most):
            part = all_words[at : at + most + size - 1]
            if block and held + len(part) > most:
                yield block
                block, held = [], 0
            block.append((name, size, part))
            held += len(part)
    yield block


def _runs(hit: np.ndarray) -> list[dict[str, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0])))).tolist()
    return [{"from": a, "to": b} for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _marked(spans, size: int) -> np.ndarray:
    """Which of a text's words lie in spans."""
    hit = np.zeros(size, bool)
    for s in spans or ():
        hit[s["from"] : s["to"]] = True
    return hit


def _bad(hit: np.ndarray, one_in: int) -> bool:
    return bool(hit.any()) and one_in * int(hit.sum()) >= len(hit)


def _digest(text) -> F.Column:
    return F.sha2(F.col(text).cast("string").cast("binary"), 256)


class _Benchmark:
    """A benchmark's windows: one broadcast set, or the merged hits of several by the texts' digests (digest, spans, items)."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, n: int, text_col: str, item_col: str, item_text_col: str, most: int):
        self.kind, context = benchmark.schema[item_col].dataType, docs.sparkSession.sparkContext
        blocks = _blocks(benchmark, n, item_col, item_text_col, most)
        first, second = next(blocks), next(blocks, None)
        self.held, self.hits = context.broadcast(WindowSet(first)), None
        if second is None:
            return
        scratch, parts, texts = Scratch(docs.sparkSession, "decontam"), None, docs.select(_digest(text_col).alias("digest"), F.col(text_col).cast("string").alias("text"))
        del first
        while self.held is not None:
            part = scratch.keep(bounded(texts).mapInArrow(self._hits(), f"digest string, spans {_SPANS}, items array<{self.kind.simpleString()}>").dropDuplicates(["digest"]), "hits")
            parts = part if parts is None else parts.unionByName(part)
            self.held.destroy()
            self.held = None if second is None else context.broadcast(WindowSet(second))
            second = next(blocks, None)
        self.hits = parts.groupBy("digest").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def _hits(self):
        """Texts that are hit, with their spans and items."""
        held, kind = self.held, pa.list_(_arrow(self.kind))

        def run(batches):
            windows = _of_worker(held)
            for batch in batches:
                rows = []
                for i, t in enumerate(batch.column(1)):
                    hit, items = windows.scan(words(t.as_py()))
                    if items:
                        rows.append((i, _runs(hit), _named(windows, items)))
                at, spans, items = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(spans, _SPAN_LIST), pa.array(items, kind)], ["digest", "spans", "items"])

        return run


_SPAN_LIST = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _named(windows: WindowSet, items: list[int]) -> list:
    """Names of items, each once, sorted."""
    return sorted({windows.names[i] for i in items}, key=lambda x: (x is None, x))


def _of_worker(held) -> WindowSet:
    windows = held.value
    claim(f"decontam {id(windows)}", windows.forget)
    return windows


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 13, one_in: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_set_words: int = MAX_SET_WORDS) -> DataFrame:
    """id_col, n_words, n_hit (long), spans (array of [from, to) word positions hit, merged), items (array of item ids), contaminated.

    One row per document row, repeated rows included; ids may be null and are only carried.
    Null or empty texts have no words and are clean; null item texts have no windows;
    equal items each own their windows, items of one id count once.  An empty benchmark
    leaves all clean.  Ids of items may be of any simple type.  A text is held whole by
    the task that scans it.  No other column is read.
    """
    windows = _Benchmark(docs, benchmark, n, text_col, item_col, item_text_col, max_set_words)
    held, kind = windows.held, pa.list_(_arrow(windows.kind))
    some = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    if windows.hits is not None:
        some = some.withColumn("digest", _digest("__text")).join(windows.hits, "digest", "left").select("__id", "__text", "spans", "items")

    def run(batches):
        own = held and _of_worker(held)
        for batch in batches:
            n_words, n_hit, spans, items, bad = [], [], [], [], []
            for i, t in enumerate(batch.column(1)):
                doc = words(t.as_py())
                if own:
                    hit, found = own.scan(doc)
                    found = _named(own, found)
                else:
                    hit, found = _marked(batch.column(2)[i].as_py(), len(doc)), batch.column(3)[i].as_py() or []
                n_words.append(len(doc))
                n_hit.append(int(hit.sum()))
                spans.append(_runs(hit))
                items.append(found)
                bad.append(_bad(hit, one_in))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(spans, _SPAN_LIST), pa.array(items, kind), pa.array(bad, pa.bool_())], [id_col, "n_words", "n_hit", "spans", "items", "contaminated"])

    return bounded(some).mapInArrow(run, f"`{id_col}` {some.schema[0].dataType.simpleString()}, n_words long, n_hit long, spans {_SPANS}, items array<{windows.kind.simpleString()}>, contaminated boolean")


def remove_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words at the given positions, and all else as it was."""
    raw = text.encode()
    flat = raw.lower().translate(_DROP)
    out, at, k, pos = [], 0, 0, 0
    edges = iter(sorted(spans))
    span = next(edges, None)
    while span is not None and pos < len(flat):
        if flat[pos] == 0x20:
            pos += 1
            continue
        end = flat.find(b" ", pos)
        end = len(flat) if end < 0 else end
        while span is not None and span[1] <= k:
            span = next(edges, None)
        if span is not None and span[0] <= k:
            out.append(raw[at:pos])
            at = end
        pos, k = end, k + 1
    return b"".join([*out, raw[at:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 13, one_in: int = 20, remove: str = "documents", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_set_words: int = MAX_SET_WORDS) -> DataFrame:
    """docs without its contaminated documents, or with their hit words removed (remove="spans").

    Columns and other rows stay as they are, whatever their names; only text_col goes
    through Python.  Null and empty texts are clean.  Repeated rows are judged alike.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    windows = _Benchmark(docs, benchmark, n, text_col, item_col, item_text_col, max_set_words)
    held, rows, spans_col = windows.held, docs, F.lit(None).cast(_SPANS)
    if windows.hits is not None:
        digest, spans = fresh(docs, "__digest", "__spans")
        hits = windows.hits.select(F.col("digest").alias(digest), F.col("spans").alias(spans))
        rows, spans_col = docs.withColumn(digest, _digest(f"`{text_col}`")).join(hits, digest, "left"), F.col(spans)

    def judged(texts: pa.Array, spans: pa.Array):
        """(text, which words are hit, whether it is contaminated) of each."""
        own = held and _of_worker(held)
        for t, s in zip(texts, spans, strict=True):
            doc = words(text := t.as_py())
            hit = own.scan(doc)[0] if own else _marked(s.as_py(), len(doc))
            yield text, hit, _bad(hit, one_in)

    @F.arrow_udf("boolean")
    def clean(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([not bad for _, _, bad in judged(*batch)], pa.bool_())

    @F.arrow_udf("string")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([remove_spans(text, [(s["from"], s["to"]) for s in _runs(hit)]) if bad else text for text, hit, bad in judged(*batch)], pa.string())

    text, rows = F.col(f"`{text_col}`").cast("string"), bounded(rows)
    if remove == "documents":
        return rows.where(clean(text, spans_col)).select(*[F.col(f"`{c}`") for c in docs.columns])
    return rows.select(*[cut(text, spans_col).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def items_digest(items: list) -> str:
    """Lowercase hex SHA-256 of the ids, sorted as strings and joined by commas."""
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
