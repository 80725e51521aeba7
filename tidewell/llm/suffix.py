"""Suffix-array dedup: bytes covered by a string of ``least`` bytes that starts earlier.

"Earlier" is a smaller document id, or an earlier start in the same document; all strings
are judged on the input.  Which windows of ``least`` bytes repeat is found by
threshold-bounded interval expansion on Burrows-Wheeler transforms (``bwt``), of blocks of
bounded size that hold every window's equals together:

1. Every window belongs to its rarest-hashed ``GRAM``-byte gram, which its equals share.
   Consecutive windows with the same gram form a segment.  Only the grams' hashes are
   shuffled, in packed blobs; segments whose gram occurs once cannot repeat.
2. Documents equal to an earlier one as a whole are set aside: all their windows repeat.
3. The other documents' segments with repeated grams are dealt out by gram.
4. A gram with more than ``MOST`` segments is split, however many there are: the earliest
   segment serves as the gram's trunk; windows that agree with it are its repeats, and
   the others branch off by the side, place and value of the byte where they part from
   it.  Each round fixes a byte more, equal strings are met once, and rounds go on
   until no branch is too large.  Grams are compared byte by byte: one that only shares
   its hash with the trunk's branches off by its bytes.
5. Each task glues its groups to blocks of about ``BLOCK`` bytes and expands intervals.

Hashes decide without a look at the bytes in two places: whole texts of equal 95 bits (2.)
and segments of equal 128 bits (4.) are taken for equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest, xxh3_128_intdigest

from tidewell.llm.bwt import later_repeats
from tidewell.llm.caches import bounded, claim
from tidewell.llm.store import Scratch

#: Bytes of the grams that segments are dealt out by (fewer if windows are shorter).
GRAM = 32
#: Segments of one gram that go to one task.
MOST = 512
#: Bytes of a block whose transform is built at once.
BLOCK = 1_000_000
#: Windows of a segment at most.
RUN = 127
#: Set in a segment's run where its gram stands in it more than once, so that a window may repeat inside.
FOLDED = 128
#: Parts that the segments of one gram are dealt out to when they meet their trunk.
SLICES = 16
#: Segments of whole texts that a task gathers before it hands them on.
HELD = 400_000
#: Bytes of text that grams are hashed of at once.
CHUNK = 262_144
_MASK = (1 << 64) - 1
_BASE = 6364136223846793005


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Cutter:
    """Cuts texts into segments: runs of windows with the same least gram hash."""

    def __init__(self, least: int, gram: int):
        self.least, self.gram = least, gram
        self.value = np.random.default_rng(20_011).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.up = self.down = np.zeros(0, np.uint64)

    def hashes(self, text: np.ndarray) -> np.ndarray:
        n, k = len(text), self.gram
        if n > len(self.up):
            self.up, self.down = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.value[text] * self.up[:n], out=total[1:])
        h = (total[k:] - total[:-k]) * self.down[: n - k + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        return h

    def cut(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(gram hash, index of the text, first window, windows) of all segments, texts in order. FOLDED is added to windows where it applies."""
        out, some, size, at = [], [], 0, 0
        for i, t in enumerate(texts):
            if len(t) >= self.least:
                if size and size + len(t) > CHUNK:
                    out.append(self._cut(some, at))
                    some, size = [], 0
                some.append((i, t))
                size += len(t)
        if some:
            out.append(self._cut(some, at))
        if not out:
            return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _cut(self, some: list[tuple[int, bytes]], at: int):
        least, width = self.least, self.least - self.gram + 1
        text = np.frombuffer(b"".join(t for _, t in some), np.uint8)
        ends = np.cumsum([len(t) for _, t in some])
        low, step = self.hashes(text), 1
        hashes = low
        while step < width:
            by = min(step, width - step)
            low = np.minimum(low[:-by], low[by:])
            step += by
        across = np.zeros(len(low) + 1, np.int64)
        across[ends[:-1] - least + 1] += 1  # from the first window that does not fit its text
        across[ends[:-1]] -= 1
        start = np.flatnonzero(np.cumsum(across[:-1]) == 0)
        mine = low[start]
        new = np.concatenate(([True], (mine[1:] != mine[:-1]) | (start[1:] != start[:-1] + 1)))
        first = np.flatnonzero(new)
        place = np.arange(len(start))
        new |= (place - np.repeat(first, np.diff(np.concatenate((first, [len(start)]))))) % RUN == 0
        first = np.flatnonzero(new)
        of = np.searchsorted(ends, start[first], side="right")
        begin = np.concatenate(([0], ends[:-1]))
        # a window that begins with its gram, and one after it with an equal gram further on
        goes_on = np.flatnonzero(np.concatenate((~new[1:], [False])) & (hashes[start] == mine))
        windows = np.diff(np.concatenate((first, [len(start)])))
        windows[np.searchsorted(first, goes_on, side="right") - 1] += FOLDED
        return mine[first], np.array([i for i, _ in some])[of], start[first] - begin[of], windows


def _mark(text: bytes) -> tuple[int, int]:
    """95 bits that stand for a whole text."""
    h = xxh3_128_intdigest(text)
    return h & _MASK, h >> 97


def _blob(column: pa.Array, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), kind) for x in column]


def _pack(buckets: int, least: int, gram: int, kind: type[Cutter] = Cutter):
    """Documents -> blobs of gram hashes and places, by bucket of the hash. A whole text goes in as a segment of no windows."""

    def flush(parts):
        key, did, rank, start, run = (np.concatenate(x) for x in zip(*parts, strict=True))
        bucket = (key % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
        rows = [b for b in range(buckets) if edge[b] < edge[b + 1]]
        cut = [order[edge[b] : edge[b + 1]] for b in rows]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(rows, pa.int32()),
                pa.array([key[c].tobytes() for c in cut], pa.binary()),
                pa.array([np.diff(did[c], prepend=0).tobytes() for c in cut], pa.binary()),
                pa.array([rank[c].tobytes() for c in cut], pa.binary()),
                pa.array([start[c].astype(np.int32).tobytes() for c in cut], pa.binary()),
                pa.array([run[c].astype(np.uint8).tobytes() for c in cut], pa.binary()),
            ],
            ["bucket", "keys", "dids", "ranks", "starts", "runs"],
        )

    def run(batches):
        claim("suffix")
        cutter, parts, held = kind(least, gram), [], 0
        for batch in batches:
            did, rank, column = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            for at in range(0, batch.num_rows, 64):
                texts = [(t.as_py() or "").encode() for t in column[at : at + 64]]
                key, of, start, windows = cutter.cut(texts)
                parts.append((key, did[at + of], rank[at + of], start, windows))
                long = np.array([i for i, t in enumerate(texts) if len(t) >= least], np.int64)
                if len(long):
                    marks = [_mark(texts[i]) for i in long]
                    parts.append((np.array([m[0] for m in marks], np.uint64), did[at + long], rank[at + long], np.array([m[1] for m in marks], np.int64), np.zeros(len(long), np.int64)))
                held += len(key)
                if held > HELD:
                    yield flush(parts)
                    parts, held = [], 0
        if parts:
            yield flush(parts)

    return run


def _match(most: int):
    """Blobs sorted by bucket -> places of segments whose gram repeats, and of whole texts that an earlier one equals."""

    def found(parts):
        key, did, rank, start, run = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(key, kind="stable")
        key, did, rank, start, run = (x[order] for x in (key, did, rank, start, run))
        new = np.concatenate(([True], key[1:] != key[:-1]))
        first = np.flatnonzero(new)
        count = np.repeat(np.diff(np.concatenate((first, [len(key)]))), np.diff(np.concatenate((first, [len(key)]))))
        keep = ((count > 1) | (run > FOLDED)) & (run > 0)
        whole = np.flatnonzero((count > 1) & (run == 0))
        if len(whole):
            by = np.lexsort((rank[whole], did[whole], start[whole], key[whole]))
            whole = whole[by]
            again = np.concatenate(([False], (key[whole][1:] == key[whole][:-1]) & (start[whole][1:] == start[whole][:-1])))
            keep[whole[again]] = True
        return pa.RecordBatch.from_arrays([pa.array(did[keep]), pa.array(rank[keep]), pa.array(np.where(run > 0, start, 0)[keep].astype(np.int32)), pa.array((run[keep] % FOLDED).astype(np.int16)), pa.array(key[keep].view(np.int64)), pa.array((count > most)[keep])], ["did", "rank", "start", "run", "key", "hot"])

    def run(batches):
        claim("suffix")
        now, parts = None, []
        for batch in batches:
            cols = [_blob(batch.column(i), k) for i, k in ((1, "<u8"), (2, "<i8"), (3, "<i4"), (4, "<i4"), (5, "u1"))]
            for i, b in enumerate(batch.column(0).to_pylist()):
                if b != now and parts:
                    yield found(parts)
                    parts = []
                now = b
                key, did, rank, start, windows = (c[i] for c in cols)
                parts.append((key, np.cumsum(did), rank, start.astype(np.int64), windows.astype(np.int64)))
        if parts:
            yield found(parts)

    return run


def _anchored(content: bytes, key: int, cutter: Cutter) -> list[tuple[int, int, int]]:
    """(first window, end, anchor) of the parts of a segment whose windows have their first gram of this hash at the same place."""
    windows = len(content) - cutter.least + 1
    spots = np.flatnonzero(cutter.hashes(np.frombuffer(content, np.uint8)) == np.uint64(key & _MASK)).tolist()
    out, at = [], 0
    for p in spots:
        if at < windows and p >= at:
            out.append((at, min(windows, p + 1), p))
            at = p + 1
    return out


_SEGMENT = "key long, same long, same2 long, content binary, did long, rank int, start int, anchor int, hot boolean"


def _segments(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in _SEGMENT.split(", ")])


def _row(key: int, content: bytes, did: int, rank: int, start: int, anchor: int, hot: bool) -> tuple:
    h = xxh3_128_intdigest(content)
    return _signed(key & _MASK), _signed(h & _MASK), _signed(h >> 64), content, did, rank, start, anchor, hot


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class _Seen:
    """Equal segments of frequent grams that one task meets: all but the first are repeats, which need not be dealt out."""

    MOST = 100_000

    def __init__(self, least: int):
        self.least, self.first = least, {}

    def row(self, row: tuple) -> tuple:
        name, at = row[:3], row[4:7]
        if self.first.setdefault(name, at) < at:
            return (None, 0, 0, None, *at, len(row[3]) - self.least + 1, False)
        if len(self.first) > self.MOST:
            self.first.clear()
        return row


def _fetch(least: int, gram: int, kind: type[Cutter] = Cutter):
    """Documents with the places of their segments -> the segments' bytes. Those of frequent grams are parted by where the gram stands."""

    def run(batches):
        claim("suffix")
        cutter, seen, rows, size = kind(least, gram), _Seen(least), [], 0
        for batch in batches:
            for did, rank, text, places in zip(*(batch.column(i) for i in range(4)), strict=True):
                places = places.as_py()
                if any(p["run"] == 0 for p in places):
                    continue
                raw, did, rank = text.as_py().encode(), did.as_py(), rank.as_py()
                for p in places:
                    start, key = p["start"], p["key"]
                    content = raw[start : start + p["run"] + least - 1]
                    if p["hot"]:
                        for a, b, anchor in _anchored(content, key, cutter):
                            rows.append(seen.row(_row(key, content[a : b + least - 1], did, rank, start + a, anchor - a, True)))
                    else:
                        rows.append((key, 0, 0, content, did, rank, start, 0, False))
                    size += len(content)
                    if size > 4_000_000:
                        yield _segments(rows)
                        rows, size = [], 0
        yield _segments(rows)

    return run


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def _branch(least: int, gram: int):
    """Segments with their gram's trunk -> spans that repeat the trunk (key null) and the branches of the rest."""

    def run(batches):
        claim("suffix")
        seen = _Seen(least)
        for batch in batches:
            rows = []
            for key, content, did, rank, start, anchor, trunk, spot in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if content == trunk and anchor == spot:
                    continue
                windows = len(content) - least + 1
                if (own := content[anchor : anchor + gram]) != trunk[spot : spot + gram]:
                    rows.append(seen.row(_row(xxh3_64_intdigest(key.to_bytes(8, "little", signed=True) + b"G" + own), content, did, rank, start, anchor, True)))
                    continue
                left = _shared(content[:anchor][::-1], trunk[:spot][::-1])
                right = _shared(content[anchor + gram :], trunk[spot + gram :])
                low, high = max(0, anchor - left), min(windows, anchor + gram + right - least + 1)
                if low < high:
                    rows.append((None, 0, 0, None, did, rank, start + low, high - low, False))
                for a, b, side, by, byte_at in ((0, min(windows, anchor - left), b"L", left, anchor - left - 1), (max(low, high), windows, b"R", right, anchor + gram + right)):
                    if a < b:
                        name = key.to_bytes(8, "little", signed=True) + side + by.to_bytes(4, "little") + content[byte_at : byte_at + 1]
                        rows.append(seen.row(_row(xxh3_64_intdigest(name), content[a : b + least - 1], did, rank, start + a, anchor - a, True)))
            yield _segments(rows)

    return run


def _folds(content: bytes, least: int) -> bool:
    """Whether a window may occur twice in a segment: it would hold a whole aligned block of half its size twice."""
    half = max(1, least // 2)
    return any(content.find(content[i : i + half], i + 1) >= 0 for i in range(0, len(content) - half + 1, half))


def _expand(least: int):
    """Segments of a task -> spans (did, rank, from, to) of windows that repeat an earlier one."""

    def spans(groups):
        firsts, out = {}, []
        for group in groups:
            own = {}
            for content, did, rank, start in group:
                at = (did, rank, start)
                if content not in own:
                    own[content] = at
                else:
                    if at < own[content]:
                        at, own[content] = own[content], at
                    out.append((at[0], at[1], at[2], at[2] + len(content)))
            if len(own) > 1 or _folds(*own, least):
                firsts.update(own)
        if firsts:
            order = sorted(firsts.items(), key=lambda x: x[1])
            for (_, (did, rank, start)), later in zip(order, later_repeats([c for c, _ in order], least), strict=True):
                if len(later):
                    cut = np.flatnonzero(np.diff(later) > 1) + 1
                    for run in np.split(later, cut):
                        out.append((did, rank, start + int(run[0]), start + int(run[-1]) + least))
        cols = list(zip(*out, strict=True)) if out else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], ["did", "rank", "from", "to"])

    def run(batches):
        claim("suffix")
        now, group, groups, size = None, [], [], 0
        for batch in batches:
            for key, content, did, rank, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    if group:
                        groups.append(group)
                    if size > BLOCK:
                        yield spans(groups)
                        groups, size = [], 0
                    now, group = key, []
                group.append((content, did, rank, start))
                size += len(content)
        if group:
            groups.append(group)
        yield spans(groups)

    return run


def _cut(texts: pa.Array, wholes: pa.Array, spans: pa.Array) -> Iterator[tuple[bytes, list[list[int]], bytes]]:
    """For each document its bytes, merged spans and kept bytes."""
    for text, whole, found in zip(texts, wholes, spans, strict=True):
        raw = (text.as_py() or "").encode()
        if whole.as_py():
            runs = [[0, len(raw)]] if raw else []
        else:
            runs = []
            for s in sorted((x["from"], x["to"]) for x in found.as_py() or ()):
                if runs and s[0] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], s[1])
                else:
                    runs.append(list(s))
        edges = [0, *[x for r in runs for x in r], len(raw)]
        yield raw, runs, b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _finish(id_col: str):
    """Documents with their spans -> n_bytes, merged spans and kept bytes."""

    def run(batches):
        claim("suffix")
        span = pa.struct([("from", pa.int64()), ("to", pa.int64())])
        for batch in batches:
            n_bytes, merged, kept = [], [], []
            for raw, runs, left in _cut(*batch.columns[1:]):
                n_bytes.append(len(raw))
                merged.append([{"from": a, "to": b} for a, b in runs])
                kept.append(left)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(merged, pa.list_(span)), pa.array(kept, pa.binary())], [id_col, "n_bytes", "spans", "kept"])

    return run


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """__row, did, rank: __row holds all columns; did orders documents; rank orders those that share an id, which is 0 for all where ids are unique."""
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} is {docs.schema[id_col].dataType.simpleString()}: ids are integers, whose order says which of two equal strings is the earlier one")
    did = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit((1 << 63) - 1))
    some = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), did.alias("did"))
    twice = some.groupBy("did").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if twice.isEmpty():
        return some.withColumn("rank", F.lit(0))
    text = F.col("__row")[text_col].cast("string")
    of = Window.partitionBy("did").orderBy(F.col("__row")[id_col].isNull(), F.xxhash64(text), text)
    return some.withColumn("rank", (F.row_number().over(of) - 1).cast("int"))


def repeats(docs: DataFrame, least: int = 100, id_col: str = "doc_id", text_col: str = "text", most: int = MOST, cutter: type[Cutter] = Cutter) -> DataFrame:
    """id_col, n_bytes (long), spans (array of maximal removed [from, to) byte ranges), kept (binary: the bytes left).

    One row per input row.  Ids are integers of any width; others raise TypeError.  A null
    text counts as empty; texts shorter than ``least`` bytes lose nothing.  A null id comes
    after all others.  Documents that share an id (repeated rows among them) count as
    documents one after the other, in the order of their texts' hashes, so that of equal
    rows only one keeps its text.  No other column is read.  Kept bytes may begin or end
    inside a character.  A text, and all spans of it, are held whole by one task.  ``cutter``
    hashes grams; the result does not depend on it.
    """
    ready = _found(docs.select(id_col, text_col), least, id_col, text_col, most, cutter)
    ready = ready.select(F.col("__row")[id_col].alias("__id"), F.col("__row")[text_col].cast("string").alias("text"), "whole", "spans")
    return bounded(ready).mapInArrow(_finish(id_col), f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes long, spans array<struct<`from`:long,`to`:long>>, kept binary")


def _found(docs: DataFrame, least: int, id_col: str, text_col: str, most: int, cutter: type[Cutter] = Cutter) -> DataFrame:
    """__row (all columns), whole, spans, one row per input row."""
    spark = bounded(docs).sparkSession
    gram = min(GRAM, max(1, least // 2))
    scratch = Scratch(spark, "suffix")
    # joins are told to merge: both sides grow with the corpus, and well compressed files look small enough to broadcast
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _numbered(docs, id_col, text_col)
    texts = rows.select("did", "rank", F.col("__row")[text_col].cast("string").alias("text"))
    packed = texts.mapInArrow(_pack(n, least, gram, cutter), "bucket int, keys binary, dids binary, ranks binary, starts binary, runs binary")
    places = scratch.keep(packed.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_match(most), "did long, rank int, start int, run short, key long, hot boolean"), "places")
    scratch.settle()

    of = places.groupBy("did", "rank").agg(F.collect_list(F.struct("start", "run", "key", "hot")).alias("places"))
    cut = texts.join(of.hint("merge"), ["did", "rank"]).select("did", "rank", "text", "places").mapInArrow(_fetch(least, gram, cutter), _SEGMENT)
    segments = scratch.keep(cut, "segments")
    scratch.settle()

    def repeated(rows: DataFrame) -> DataFrame:
        """Spans of rows that are no segments but windows known to repeat."""
        return rows.where("key is null").select("did", "rank", F.col("start").alias("from"), (F.col("start") + F.col("anchor") + (least - 1)).alias("to"))

    groups, spans, used = [segments.where("key is not null and not hot").select("key", "content", "did", "rank", "start")], [repeated(segments)], []
    hot = segments.where("hot")
    while not hot.isEmpty():
        at = F.struct("did", "rank", "start")
        firsts = hot.groupBy("key", "same", "same2").agg(F.min(at).alias("first"))
        once = hot.join(firsts.hint("merge"), ["key", "same", "same2"])
        spans.append(once.where(at != F.col("first")).select("did", "rank", F.col("start").alias("from"), (F.col("start") + F.length("content")).alias("to")))
        once = scratch.keep(once.where(at == F.col("first")).drop("first").withColumn("slice", F.pmod(F.xxhash64("same"), F.lit(SLICES)).cast("int")), "once")
        trunks = once.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("content", "anchor"), at).alias("trunk"))
        parted = once.join(trunks.withColumn("slice", F.explode(F.array(*map(F.lit, range(SLICES))))).hint("merge"), ["key", "slice"])
        groups.append(parted.where(F.col("n") <= most).select("key", "content", "did", "rank", "start"))
        branches = parted.where(F.col("n") > most).select("key", "content", "did", "rank", "start", "anchor", "trunk.content", "trunk.anchor").toDF("key", "content", "did", "rank", "start", "anchor", "trunk", "spot").mapInArrow(_branch(least, gram), _SEGMENT)
        branches = scratch.keep(branches, "branches")
        used += [once, branches]
        spans.append(repeated(branches))
        hot = branches.where("key is not null")

    every = groups[0]
    for g in groups[1:]:
        every = every.unionByName(g)
    found = every.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_expand(least), "did long, rank int, `from` int, `to` int")
    for s in spans:
        found = found.unionByName(s)
    ranges = scratch.keep(found, "spans")
    scratch.drop(segments, *used)
    scratch.settle()

    by_doc = ranges.groupBy("did", "rank").agg(F.collect_list(F.struct("from", "to")).alias("spans"))
    whole = places.where("run = 0").select("did", "rank", F.lit(True).alias("whole")).distinct()
    found = by_doc.join(whole, ["did", "rank"], "full")
    return rows.join(found.hint("merge"), ["did", "rank"], "left").select("__row", "whole", "spans")


def without_repeats(docs: DataFrame, least: int = 100, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """docs with text_col cut down to the kept bytes, and without documents of which nothing is left.

    Documents without repeats stay as they are.  Bytes of a character that was cut in two
    are left out.  Repeated rows, shared and null ids are as in ``repeats``: each row is cut
    by its own spans.  Other columns are unchanged, whatever their names.
    """

    @F.arrow_udf("string")
    def kept(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        claim("suffix")
        for batch in batches:  # null where nothing is cut
            yield pa.array([left.decode(errors="ignore") if runs else None for _, runs, left in _cut(*batch)], pa.string())

    found, row = _found(docs, least, id_col, text_col, most), F.col("__row")
    # said not to be deterministic, so that the filter does not run it a second time
    out = found.select("__row", kept.asNondeterministic()(row[text_col].cast("string"), "whole", "spans").alias("__kept")).where("__kept is null or __kept <> ''")
    return out.select(*[(F.coalesce("__kept", row[c]) if c == text_col else row[c]).alias(c) for c in docs.columns])
