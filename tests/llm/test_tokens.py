"""Byte-level BPE, lengths and fertility against the public libraries and plain counts."""

import random

import public_tokenizers as P
import pytest
import tiktoken

from tidewell.llm import bpe, fertility, lengths

PATH = P.path("byte_bpe_multi_50k.tiktoken")
PIECES = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def texts():
    r = random.Random(2)
    odd = " \n\t\xa0ab'sé漢🙂.1   x\x1c"
    out = ["".join(r.choice(odd) for _ in range(r.randint(0, 50))) for _ in range(400)]
    return [*out, "", "don't we'll go", "<|endoftext|> x", "é" * 300, "ab" * 700 + "c", " " * 90, "word  \n  word", "Der Größe nach"]


def test_encoding_equals_library(library):
    own = bpe.encoder(PATH, P.PATTERN)
    for t in texts():
        ids = own.encode(t)
        assert ids == library.encode_ordinary(t), repr(t)
        assert own.decode(ids) == t.encode()


@pytest.mark.parametrize("pattern", [r"\w+|\s+|[^\w\s]+", r"(\w)(\w*)|\s|[^\w\s]+", r"[a-z]+", r"\S+\s?"])
def test_other_patterns_equal_the_library(pattern):
    ranks = bpe.read_ranks(PATH)
    theirs = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    own = bpe.ByteBpe(ranks, pattern)
    for t in [*texts()[:120], "one two  three, four.", "Der Größe nach"]:
        assert own.encode(t) == theirs.encode_ordinary(t), repr(t)


def test_rows_and_long_tree_agree(library):
    own = bpe.encoder(PATH, P.PATTERN)
    r = random.Random(4)
    pieces = [bytes(r.choice(b"abcdeth\xc3\xa9 ") for _ in range(r.randint(2, 64))) for _ in range(300)]
    ids, counts = own.merge_rows(pieces, 64)
    at = 0
    for p, c in zip(pieces, counts, strict=True):
        assert ids[at : at + c].tolist() == bpe.merge_long(p, own.ranks)
        at += c


def test_round_trip_frame(spark, library):
    rows = [(1, "Hello world", "x"), (None, "é " * 40, "y"), (1, "Hello world", "x"), (2, None, "z"), (3, "", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.encode_decode(df, PATH, P.PATTERN).collect()
    assert len(out) == 5
    for r in out:
        text = bytes(r.decoded).decode()
        assert r.ids == library.encode_ordinary(text)
    assert sorted(bytes(r.decoded).decode() for r in out) == sorted(t or "" for _, t, _ in rows)
    assert bpe.encode_decode(df.limit(0), PATH, P.PATTERN).collect() == []


def test_length_sums(spark):
    r = random.Random(1)
    n = [r.choice([0, 1, 5, 1023, 1024, 5000, r.randrange(9000)]) for _ in range(300)] + [None]
    own = [x or 0 for x in n]
    sums = lengths.suffix_sums(lengths.length_histogram(spark.createDataFrame([(x,) for x in n], "n_tokens long")))
    for row in sums.collect():
        x = row.length
        assert row.n_docs == own.count(x) and row.docs_ge == sum(v >= x for v in own) and row.tokens_ge == sum(v for v in own if v >= x)
        assert row.truncated_tokens == sum(min(v, x) for v in own) and row.truncated_tokens + row.lost_tokens == sum(own) and row.n_total == len(own)
    got = {x.limit: x for x in lengths.at_limits(sums, [0, 100, 10_000]).collect()}
    assert all(got[k].truncated_tokens == sum(min(v, k) for v in own) and got[k].docs_over == sum(v > k for v in own) for k in got)
    want = sorted(own)[150]
    assert {x.q: x.length for x in lengths.quantiles(sums, [0.5, 1.0]).collect()} == {0.5: want, 1.0: max(own)}
    assert lengths.suffix_sums(lengths.length_histogram(spark.createDataFrame([], "n_tokens long"))).collect() == []


def test_base_counts():
    assert fertility.repeated_words("a b c a b c d".split()) == 6
    assert fertility.repeated_words("a a a a".split()) == 4
    assert fertility.repeated_words("a b".split()) == 0
    assert fertility.repeated_lines("x\nx\n\n\n x\nx\r") == 1


def test_assess(spark, library):
    good = " ".join(f"word{i} thing{i * 7}" for i in range(40))
    rows = [(1, good), (2, None), (3, "a b c " * 60), (4, "漢字 " * 60), (None, good + " $$ #"), (1, good)]
    df = spark.createDataFrame([(i, t, True) for i, t in rows], "doc_id long, text string, kept boolean")
    out = fertility.assess(df, PATH, P.PATTERN, PIECES).collect()
    by = {(r.doc_id, r.n_words): r for r in out}
    assert len(out) == 6 and by[1, 80].kept and not by[1, 80].base_failed
    assert by[2, 0].base_failed and not by[2, 0].kept and by[2, 0].script is None
    assert by[3, 180].base_failed and by[3, 180].n_repeat_words == 180
    assert by[None, 82].n_symbols == 3 and by[1, 80].word_chars == len(good.replace(" ", ""))
    assert by[1, 80].n_tokens == sum(len(library.encode_ordinary(" " + w)) for w in good.split())
    assert by[4, 60].script == "CJK"
    assert fertility.assess(df.limit(0), PATH, P.PATTERN, PIECES).collect() == []


def test_reference_bands_reject_by_each_measure(spark):
    r = random.Random(8)
    some = "the people house water government morning reading little before another through under great small river city paper long night table green every story again".split()
    plain = lambda n: [r.choice(some) + r.choice(["", "", "s", "ing"]) for _ in range(n)]
    rows = [(i, " ".join(plain(r.randint(60, 120)))) for i in range(300)]
    poor = [i for i in range(1000, 1150)]
    rows += [(i, " ".join(w[:3] + "%#&$" for w in plain(80))) for i in poor]  # unrated, but not rated good
    cycle = [some[i] for i in de_bruijn(5, 3)]  # few words, no repeated windows
    odd = {
        "chars_per_token low": " ".join(f"{w[:2]}%{w[2:4]}$#&" for w in plain(90)),
        "chars_per_token high": " ".join(r.choice(["disproportionately", "government", "through", "another"]) + r.choice(["", "al"]) for _ in range(90)),
        "fallback_share": " ".join(w if i % 6 else w + "\U00013000" for i, w in enumerate(plain(90))),
        "token_entropy": " ".join(cycle),
    }
    rows += [(2000 + i, t) for i, t in enumerate(odd.values())] + [(3000, " ".join(plain(90))), (None, " ".join(plain(90)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    good = spark.createDataFrame([(i,) for i in range(300)], "doc_id long")
    measured = fertility.measure(df, PATH, P.PATTERN, PIECES).cache()
    band = fertility.reference_bands(measured.where("doc_id < 300"))["LATIN"]
    out = {x.doc_id: x for x in fertility.assess(df, PATH, P.PATTERN, PIECES, good=good).collect()}
    at = dict(zip(odd, (out[2000 + i] for i in range(len(odd))), strict=True))
    assert at["chars_per_token low"].chars_per_token < band.min_chars
    assert at["chars_per_token high"].chars_per_token > band.max_chars
    assert at["fallback_share"].fallback_share > band.max_fallback
    assert at["token_entropy"].token_entropy < band.min_entropy
    assert not any(x.base_failed or x.kept for x in at.values())
    assert not any(out[i].kept or out[i].base_failed for i in poor)
    assert sum(out[i].kept for i in range(300)) >= 297 and out[3000].kept and out[None].kept


def test_fixed_bands_can_bind(spark):
    greek = "όλοι άνθρωποι γεννιούνται ελεύθεροι ίσοι αξιοπρέπεια δικαιώματα είναι προικισμένοι λογική συνείδηση οφείλουν συμπεριφέρονται μεταξύ πνεύμα αδελφοσύνης κάθε επικαλείται χωρίς καμία διάκριση".split()
    r = random.Random(4)
    clean = [r.choice(greek) for _ in range(80)]
    cut = [w for x in clean for w in x][:300]
    r.shuffle(cut)
    words = "αβγδ"
    cycle = [words[i] for i in de_bruijn(4, 3)]
    texts = [" ".join(clean), "".join(c + ("%" if i % 2 else "# ") for i, c in enumerate(cut)), " ".join(w + "\u1fa7\u1f8f\u1f9b" for w in clean), " ".join(cycle)]
    out = {x.doc_id: x for x in fertility.assess(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH, P.PATTERN, PIECES).collect()}
    band = fertility.BANDS["GREEK"]
    assert all(x.script == "GREEK" and not x.base_failed for x in out.values())
    assert out[1].chars_per_token < band.min_chars
    assert out[2].fallback_share > band.max_fallback and out[3].token_entropy < band.min_entropy
    assert [out[i].kept for i in range(4)] == [True, False, False, False]


def test_script_of_mixed_words(spark):
    rows = [(1, "Tokyo東京都庁舎前広場"), (2, "NHK放送センター前でニュースキャスターがリポート"), (3, "東a " * 3), (4, "a東 " * 3), (5, "42%"), (6, "Москваabc xyz")]
    measured = fertility.measure(spark.createDataFrame(rows, "doc_id long, text string"), PATH, P.PATTERN, PIECES).collect()
    assert {r.doc_id: r.script for r in measured} == {1: "CJK", 2: "KATAKANA", 3: "CJK", 4: "CJK", 5: None, 6: "CYRILLIC"}
    line = "Sony株式会社東京都港区本社研究開発部門長発表新型携帯電話販売開始予定日"
    clean = [line[:4] + "".join(random.Random(i).sample(line[4:], 20)) for i in range(60)]
    (row,) = fertility.assess(spark.createDataFrame([(1, " ".join(clean))], "doc_id long, text string"), PATH, P.PATTERN, PIECES).collect()
    assert row.script == "CJK" and row.chars_per_token < fertility.BANDS["LATIN"].min_chars and row.kept


def de_bruijn(k, n):
    """A cyclic sequence with every window of n of k symbols once."""
    a, out = [0] * k * n, []

    def step(t, p):
        if t > n:
            if n % p == 0:
                out.extend(a[1 : p + 1])
            return
        a[t] = a[t - p]
        step(t + 1, p)
        for j in range(a[t - p] + 1, k):
            a[t] = j
            step(t + 1, t)

    step(1, 1)
    return out
