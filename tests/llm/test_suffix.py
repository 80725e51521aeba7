import random

import numpy as np
import pyarrow as pa
import pytest

from tidewell.llm import suffix
from tidewell.llm.bwt import later_repeats


def brute(docs, least):
    """(doc_id, n_bytes, spans, kept) of unique ids, by a set of all windows."""
    seen, out = set(), []
    for doc_id, text in sorted(docs):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - least + 1):
            w = raw[i : i + least]
            if w in seen:
                gone[i : i + least] = b"\1" * least
            seen.add(w)
        spans, at = [], 0
        while at < len(raw):
            end = at
            while end < len(raw) and gone[end] == gone[at]:
                end += 1
            if gone[at]:
                spans.append((at, end))
            at = end
        out.append((doc_id, len(raw), spans, bytes(b for b, g in zip(raw, gone, strict=True) if not g)))
    return out


def got(df):
    return sorted((r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in df.collect())


def texts(seed, n, alphabet, pieces=6, size=60):
    r = random.Random(seed)
    base = ["".join(r.choice(alphabet) for _ in range(r.randint(1, size))) for _ in range(pieces)]
    out = []
    for _ in range(n):
        t = "".join(r.choice(base) for _ in range(r.randint(0, 4)))
        if t and r.random() < 0.6:
            i = r.randrange(len(t))
            t = t[:i] + r.choice(alphabet) + t[i + 1 :]
        out.append(t)
    return out


@pytest.mark.parametrize("least", [1, 5, 30])
def test_interval_expansion(least):
    for seed in range(30):
        strings = [t.encode() for t in texts(seed, 5, "ab" if seed % 2 else "abcé ")]
        seen, want = set(), []
        for s in strings:
            want.append([])
            for i in range(len(s) - least + 1):
                if s[i : i + least] in seen:
                    want[-1].append(i)
                seen.add(s[i : i + least])
        assert [x.tolist() for x in later_repeats(strings, least)] == want


@pytest.mark.parametrize("seed,least,most,alphabet", [(1, 12, 512, "abc "), (2, 12, 2, "abcdé"), (3, 20, 1, "ab"), (4, 100, 3, "abcdefgh ")])
def test_repeats_equal_brute_force(spark, seed, least, most, alphabet):
    size = 40 if least < 100 else 260
    docs = [(i, t if i % 17 else None) for i, t in enumerate(texts(seed, 60, alphabet, size=size))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert got(suffix.repeats(df, least, most=most)) == brute(docs, least)


@pytest.mark.parametrize("keep,most", [(3, 2), (0, 1)])
def test_grams_of_one_hash_are_told_apart(spark, keep, most):
    class Few(suffix.Cutter):
        """Hashes of two bits, or all the same."""

        def hashes(self, text):
            return super().hashes(text) & np.uint64(keep)

    docs = [(i, t) for i, t in enumerate(texts(8, 40, "abcd ", size=40))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert got(suffix.repeats(df, 12, most=most, cutter=Few)) == brute(docs, 12)


def test_trunk_of_another_gram_repeats_nothing():
    row = pa.RecordBatch.from_arrays([pa.array([5]), pa.array([b"x" * 60 + b"B" * 32 + b"y" * 60], pa.binary()), pa.array([9]), pa.array([0], pa.int32()), pa.array([0], pa.int32()), pa.array([60], pa.int32()), pa.array([b"x" * 60 + b"A" * 32 + b"y" * 60], pa.binary()), pa.array([60], pa.int32())], ["key", "content", "did", "rank", "start", "anchor", "trunk", "spot"])
    (out,) = list(suffix._branch(100, 32)([row]))
    assert out.column("key").null_count == 0 and out.num_rows == 1 and out.column("content")[0].as_py() == row.column(1)[0].as_py()


def test_ids(spark):
    with pytest.raises(TypeError):
        suffix.repeats(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
    t = "".join(chr(97 + i * i % 26) + str(i) for i in range(60))[:130]
    out = {r.doc_id: len(r.kept) for r in suffix.repeats(spark.createDataFrame([(None, t), (2**63 - 1, t)], "doc_id long, text string")).collect()}
    assert out == {None: 0, 2**63 - 1: 130}


def test_long_periodic_text(spark):
    alone = [(1, "q" * 300), (2, "Stone. " * 40), (3, "".join(map(str, range(90))))]
    assert got(suffix.repeats(spark.createDataFrame(alone, "doc_id long, text string"))) == brute(alone, 100)
    docs = [(1, "x" * 900), (2, "xy" * 400), (3, "x" * 150 + "q"), (4, ""), (5, "short")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(suffix.repeats(df, most=1)) == brute(docs, 100)


def test_empty_nulls_and_repeated_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string, kept string")
    assert suffix.repeats(df).collect() == []
    t = "".join(chr(97 + i * i % 26) + str(i) for i in range(60))[:130]
    df = spark.createDataFrame([(None, t), (7, t), (7, t), (7, None), (8, "é" * 70)], "doc_id long, text string")
    rows = sorted(((r.doc_id, r.n_bytes, len(r.kept)) for r in suffix.repeats(df).collect()), key=str)
    assert sorted(rows, key=str) == sorted([(None, 130, 0), (7, 0, 0), (7, 130, 130), (7, 130, 0), (8, 140, 2)], key=str)


def test_without_repeats_keeps_columns(spark):
    t = "".join(chr(97 + i * i % 26) + str(i) for i in range(80))
    df = spark.createDataFrame([(1, t, "a", 3), (2, t, "b", 3), (3, "new " + t + " end", "c", 3), (4, "clean", "d", 3), (5, None, "e", 3)], "doc_id long, text string, spans string, did int")
    out = {r.doc_id: r for r in suffix.without_repeats(df).collect()}
    assert sorted(out) == [1, 3, 4, 5]
    assert (out[1].text, out[3].text, out[3].spans, out[5].text) == (t, "new  end", "c", None)


def test_without_repeats_of_shared_and_null_ids(spark):
    r = random.Random(6)
    a, b, c, d, e = ("".join(r.choice("abcdefghij ") for _ in range(150)) for _ in range(5))
    rows = [(7, a, 1), (7, a, 1)]  # equal rows: one keeps its text
    rows += [(1, b, 2), (9, "x " + b, 3), (9, c, 4)]  # one of two that share an id is cut
    rows += [(None, d, 5), (None, d, 6), (None, d, 7), (None, e, 8), (None, None, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3)
    out = [(x.doc_id, x.text, x.n) for x in suffix.without_repeats(df).collect()]
    assert [x for x in out if x[0] == 7] == [(7, a, 1)]
    assert sorted(x for x in out if x[0] in (1, 9)) == [(1, b, 2), (9, c, 4), (9, "x ", 3)]
    null = [x for x in out if x[0] is None]
    assert sorted(t or "" for _, t, _ in null) == sorted(["", d, e]) and {n for _, t, n in null if t != d} == {8, 9}
    assert len(out) == 7
