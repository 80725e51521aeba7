"""SimHash near-duplicates by a self-join of binary tries.

A fingerprint is the bitwise majority of the XXH64 of a document's word shingles.  Two
fingerprints link if they differ in at most ``budget`` bits.

Links are found in a trie of the distinct fingerprints: node pairs are walked together,
their differing bits are added up, and a pair over the budget is left at once.  The walk
is dealt out by the nodes it passes: of ``budget + 1`` blocks of the free bits at least
one is equal in a linked pair, so the pair meets below the node that fixes this block.
A node with more than ``most`` fingerprints below it fixes a further block of its free
bits, and so on; every step fixes a third of them, so that after a few steps no node
can hold more than ``most``, however alike the documents are.  Nodes that small are
joined by one task, which returns each fingerprint's least partner-by-links, not pairs.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidewell.llm.caches import bounded, claim
from tidewell.llm.components import components
from tidewell.llm.names import fresh
from tidewell.llm.store import Scratch

BITS = 64
#: Fingerprints that one task walks as one trie.
MOST = 128


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned fingerprint of a text; 0 if it is null or has no words."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    spans = zip(starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist(), strict=True)
    h = np.array([xxh64_intdigest(line[a:b], seed) for a, b in spans], "<u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, text_key (hash of the text), fp (the 64 bits as a signed long), one row per input row."""
    some = docs.select(F.col(id_col).alias(id_col), F.xxhash64(text_col).alias("text_key"), F.col(text_col).cast("string").alias("__text"))

    def run(batches):
        claim("simhash")
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp.view(np.int64))], [id_col, "text_key", "fp"])

    return bounded(some).mapInArrow(run, f"`{id_col}` {some.schema[0].dataType.simpleString()}, text_key long, fp long")


def linked(values: list[int], budget: int) -> Iterator[tuple[int, int]]:
    """Index pairs of sorted distinct values that differ in at most ``budget`` bits: both subtrees of a trie are walked together."""
    todo = [(0, len(values), 0, len(values))]
    while todo:
        a, a_end, b, b_end = todo.pop()
        above_a = (values[a] ^ values[a_end - 1]).bit_length()
        if a == b:
            if a_end - a > 1:
                mid = bisect_left(values, values[a_end - 1] >> (above_a - 1) << (above_a - 1), a, a_end)
                todo += [(a, mid, a, mid), (mid, a_end, mid, a_end), (a, mid, mid, a_end)]
            continue
        above_b = (values[b] ^ values[b_end - 1]).bit_length()
        if ((values[a] ^ values[b]) >> max(above_a, above_b)).bit_count() > budget:
            continue
        if above_a == above_b == 0:
            yield a, b
        elif above_a >= above_b:
            mid = bisect_left(values, values[a_end - 1] >> (above_a - 1) << (above_a - 1), a, a_end)
            todo += [(a, mid, b, b_end), (mid, a_end, b, b_end)]
        else:
            mid = bisect_left(values, values[b_end - 1] >> (above_b - 1) << (above_b - 1), b, b_end)
            todo += [(a, a_end, b, mid), (a, a_end, mid, b_end)]


def _roots(values: list[int], budget: int) -> list[tuple[int, int]]:
    """(value, least value it reaches by links) for those that have any."""
    up = list(range(len(values)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, j in linked(values, budget):
        a, b = root(i), root(j)
        up[max(a, b)] = min(a, b)
    return [(values[i], values[r]) for i in range(len(values)) if (r := root(i)) != i]


def _parts(mask: int, n: int) -> list[int]:
    """The mask with each of n blocks of its free bits fixed as well."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    cuts = [len(free) * i // n for i in range(n + 1)]
    return [mask | sum(1 << b for b in free[x:y]) for x, y in zip(cuts, cuts[1:], strict=False) if y > x]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _edges(batches, budget: int):
    """Edges of the tries in rows sorted by node; a node's rows may lie in several batches."""
    claim("simhash")
    now, held = None, []

    def done():
        if len(held) > 1:
            return _roots(sorted(held), budget)
        return []

    for batch in batches:
        mask, value, fp = (c.to_numpy() for c in batch.columns)
        edge = np.flatnonzero((mask[1:] != mask[:-1]) | (value[1:] != value[:-1])) + 1
        out = []
        unsigned = fp.view(np.uint64).tolist()
        for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(fp)], strict=True):
            node = (int(mask[a]), int(value[a])) if b > a else now
            if node != now:
                out += done()
                now, held = node, []
            held += unsigned[a:b]
        yield _batch(out)
    yield _batch(done())


def _batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    u, v = (np.array([p[i] for p in pairs], np.uint64).view(np.int64) for i in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def links(distinct: DataFrame, scratch: Scratch, budget: int = 2, most: int = MOST) -> DataFrame:
    """Edges u, v over distinct fingerprints fp, whose components are those of all links."""
    if most <= budget + 1:
        raise ValueError("most must exceed budget + 1: a node with so few free bits cannot be parted without losing links")
    masks = sorted(set(_parts(0, budget + 1)))
    rows, parts = distinct.select("fp"), []
    while masks:
        nodes = rows.select("fp", F.explode(F.array(*[F.lit(_signed(m)).cast("long") for m in masks])).alias("mask")) if not parts else rows
        nodes = nodes.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = nodes.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        full = scratch.keep(nodes.join(sizes, ["mask", "value"]).select("mask", "value", "fp", "n"), "nodes")
        parts.append(full)
        small = full.where(F.col("n") <= most).select("mask", "value", "fp")
        parts[-1] = (full, small)
        finer = {m: sorted(set(_parts(m, budget + 1))) for m in masks}
        masks = sorted({x for xs in finer.values() for x in xs})
        large = full.where(F.col("n") > most)
        if large.isEmpty():
            break
        into = F.create_map(*[x for m, xs in finer.items() for x in (F.lit(_signed(m)).cast("long"), F.array(*[F.lit(_signed(y)).cast("long") for y in xs]))])
        rows = large.select("fp", F.explode(into[F.col("mask")]).alias("mask")).distinct()
    every = None
    for _, small in parts:
        every = small if every is None else every.unionByName(small)
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = every.repartition(n, "mask", "value").sortWithinPartitions("mask", "value").mapInArrow(lambda it: _edges(it, budget), "u long, v long")
    edges = scratch.keep(found, "links")
    scratch.drop(*[full for full, _ in parts])
    return edges


def near_duplicates(docs: DataFrame, shingle: int = 3, budget: int = 2, seed: int = 42, most: int = MOST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, text_key, fp (long), component_id: the least id in the component of links a document belongs to.

    One row per input row.  A null or wordless text has fingerprint zero, which links like
    any other.  Equal texts, repeated ids and rows are in one component each by their equal
    fingerprints.  A null id is carried and never names a component, unless no member has
    an id: then component_id is null.  Ids are of any type that has an order.  A text is
    held whole by the task that reads it.  No other column is read.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.keep(fingerprints(docs, shingle, seed, id_col, text_col).select(F.col(id_col).alias("__id"), "text_key", "fp"), "fingerprints")
    distinct = scratch.keep(rows.groupBy("fp").agg(F.min("__id").alias("low")), "distinct")
    edges = links(distinct, scratch, budget, most)
    roots = components(edges, scratch)
    of = roots.join(distinct, roots.node == distinct.fp).select("fp", "root", "low")
    least = of.groupBy("root").agg(F.min("low").alias("least"))
    label = distinct.join(of.join(least, "root").select(F.col("fp").alias("__fp"), "least"), F.col("fp") == F.col("__fp"), "left")
    # written, so that the join below is of two plain tables, which is split where a fingerprint is very frequent
    label = scratch.keep(label.select("fp", F.coalesce("least", "low").alias("component_id")), "labels")
    scratch.drop(distinct, edges)
    return rows.join(label, "fp").select(F.col("__id").alias(id_col), "text_key", "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one document of each component: the one whose id names it.

    Columns stay as they are, whatever their names.  Of repeated rows one stays.  Documents without an id stay
    one per text, where no linked document has an id; of texts that share an id one each.
    """
    key, own, text = fresh(docs, "__key", "__id", "__text")
    named = docs.withColumn(key, F.xxhash64(f"`{text_col}`"))
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    kept = found.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias(own), F.col("text_key").alias(text)).distinct()
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(own)) & (F.col(key) == F.col(text))
    out = named.join(kept, same, "left_semi")
    if not found.groupBy(id_col, "text_key").count().where("count > 1").isEmpty():
        out = out.dropDuplicates([id_col, key])  # moves whole texts again
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
