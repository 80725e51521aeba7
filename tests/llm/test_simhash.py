import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tidewell.llm import simhash
from tidewell.llm.components import components
from tidewell.llm.store import Scratch


def slow(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(values, budget):
    """value -> least value reachable."""
    left, out = set(values), {}
    while left:
        todo = [min(left)]
        root = todo[0]
        left.discard(root)
        while todo:
            x = todo.pop()
            out[x] = root
            near = {y for y in left if (x ^ y).bit_count() <= budget}
            left -= near
            todo += near
    return out


def test_fingerprint():
    for t in (None, "", " \n", "One", "one TWO", "a b c d e É é a b c", "x " * 500):
        assert simhash.fingerprint(t) == slow(t)


@pytest.mark.parametrize("budget", [0, 1, 2, 3])
def test_trie_join_finds_all_links(budget):
    r = random.Random(budget)
    for _ in range(40):
        centre = r.getrandbits(64)
        values = sorted({centre ^ sum(1 << r.randrange(64) for _ in range(r.randint(0, 4))) for _ in range(40)} | {r.getrandbits(64) for _ in range(10)})
        want = {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= budget}
        pairs = [tuple(sorted((values[i], values[j]))) for i, j in simhash.linked(values, budget)]
        assert set(pairs) == want and len(pairs) == len(want)


def test_links_of_crowded_nodes(spark):
    r = random.Random(5)
    centres = [r.getrandbits(64) for _ in range(3)]
    values = sorted({c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for c in centres for _ in range(150)} | {r.getrandbits(64) for _ in range(50)} | {0})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    scratch = Scratch(spark, "test")
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), scratch, 2, most=8)
    found = {r.node % (1 << 64): r.root % (1 << 64) for r in components(edges, scratch).collect()}
    want = brute(values, 2)
    groups, mine = {}, {}
    for v in values:
        groups.setdefault(want[v], set()).add(v)
        mine.setdefault(found.get(v, v), set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (102, 101), (200, 200)]
    found = dict(components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "test")).collect())
    assert found == {**dict.fromkeys(range(61), 0), **dict.fromkeys((100, 101, 102), 100)}


def test_near_duplicates(spark):
    rows = [(5, "a b c d"), (3, "A  b\nc D"), (3, "A  b\nc D"), (9, None), (8, " "), (1, "other words stand here alone"), (None, "a b c d"), (None, "only without id")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string")
    out = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert out == sorted([(5, 3), (3, 3), (3, 3), (9, 8), (8, 8), (1, 1), (None, 3), (None, None)], key=str)
    kept = simhash.one_of_each(df).collect()
    assert sorted((r.doc_id for r in kept), key=str) == [1, 3, 8, None] and {r.component_id for r in kept} == {"x"}
    assert simhash.near_duplicates(df.limit(0)).collect() == []
    clash = df.withColumn("__key", F.lit(5)).withColumn("__ID", F.lit("k")).withColumn("__text", F.lit(1.5))
    assert [(r["__key"], r["__ID"], r["__text"]) for r in simhash.one_of_each(clash).collect()] == [(5, "k", 1.5)] * 4
    with pytest.raises(ValueError):
        simhash.near_duplicates(df, most=3)
