"""The registered queries on a small folder of tables, against plain computations."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from test_filters import brute_hits
from test_simhash import brute as least_reachable
from test_simhash import slow as slow_fingerprint
from test_suffix import brute as brute_repeats

import corpus_pipeline
from tidewell.llm import bpe, queries

SPACE = " \t\n\r\x0b\x0c"


def prose(r, n, letters="abcdefghilmnoprstu"):
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(21)
    own = {"en": "abcdefgh", "xx": "aeiéñàmn", "yy": "opqrstuv"}
    docs = [(i, prose(r, r.randint(1, 120), own[k]), k) for i, k in enumerate("en xx yy".split() * 14)]
    item, passage = prose(r, 30), prose(r, 40)
    docs += [(100, docs[4][1], "xx"), (101, docs[5][1] + " x", "yy"), (102, None, "en"), (103, "", "en"), (104, "½ ² 12", None), (105, "ab cd ef " * 40, "en")]
    docs += [(106, prose(r, 20) + " " + item, "en"), (107, prose(r, 60) + "\n" + passage, "en"), (108, prose(r, 55) + "\n" + passage + "\nsame line\nsame line", "en"), (109, "#*$ " * 70 + "漢字 é", None)]
    docs += [(110, prose(r, 120) + " " + prose(r, 200_000), "en")]  # over a megabyte
    base = tmp_path_factory.mktemp("tables")
    put = lambda rows, schema, name: spark.createDataFrame(rows, schema).coalesce(2).write.parquet(str(base / f"{name}.parquet"))
    put([(i, t, k, "s", len(t or ""), 1) for i, t, k in docs], "doc_id long, text string, lang string, source string, n_chars long, kept int", "documents")
    put([(7, item), (8, "short one here"), (9, None), (10, item)], "item_id long, text string", "benchmark")
    put([(i, i % 2, int(i % 7 == 0)) for i in range(0, 40)], "doc_id long, quality int, toxic int", "labels")
    put([(c, t, ("user", "assistant")[t % 2], f"text {c // 2} {t}") for c in range(9) for t in range(1 + c % 4)], "conv_id long, turn int, role string, text string", "conversations")
    put([(i, f"https://{h}/{i}") for i, h in enumerate(["a.b.example", "c.b.example", "b.example", "w.x.y.example"] * 5)], "page_id long, url string", "pages")
    return str(base), {i: t for i, t, _ in docs}


def by_id(df):
    rows = df.collect()
    out = {x.doc_id: x for x in rows}
    assert len(out) == len(rows)
    return out


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path(queries.RANKS)), special_tokens={})


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def test_op1(spark, folder, library):
    pieces = sentencepiece.SentencePieceProcessor(model_file=P.path(queries.PIECES))
    out = by_id(queries.op1_fertility(spark, folder[0]))
    assert out.keys() == folder[1].keys()
    for i, t in folder[1].items():
        words, x = re.findall("[^\\x20\\x09-\\x0D]+", t or ""), out[i]
        grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        count = Counter(grams)
        hit = {k + j for k, g in enumerate(grams) if count[g] > 1 for j in range(3)}
        lines = [line for line in (t or "").split("\n") if line.strip(SPACE)]
        assert (x.n_words, x.word_chars, x.n_symbols) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""))
        assert (x.n_dup_lines, x.n_repeat_words) == (len(lines) - len(set(lines)), len(hit))
        assert x.base_failed == (len(words) < 50 or 100 * len(hit) > 50 * len(words)) and not (x.base_failed and x.kept)
        if words and i != 110:
            tokens = Counter(k for w in words for k in library.encode_ordinary(" " + w))
            own = [k for w in words for k in pieces.encode(w)]
            n = sum(tokens.values())
            assert x.n_tokens == n and x.chars_per_token == pytest.approx(x.word_chars / n)
            assert x.fallback_share == pytest.approx(sum(map(pieces.IsByte, own)) / len(own))
            assert x.token_entropy == pytest.approx(-sum(c / n * math.log2(c / n) for c in tokens.values()), abs=1e-9)


def test_op2(spark, folder):
    out = by_id(queries.op2_ordinal_quality(spark, folder[0]))
    assert out.keys() == folder[1].keys()
    assert all(0 <= x.expected_grade <= 2 and 0 <= x.tail_probability <= 1 and x.kept == (x.tail_probability >= 0.5) for x in out.values())


def test_op3_and_op8(spark, folder, library):
    out = by_id(queries.op3_byte_bpe(spark, folder[0]))
    assert out.keys() == folder[1].keys()
    lens = []
    for i, t in folder[1].items():
        ids = library.encode_ordinary(t or "")
        lens.append(len(ids))
        assert (out[i].n_tokens, out[i].ids_sha256, out[i].decoded_sha256) == (len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode()))
    rows = queries.op8_length_histogram(spark, folder[0]).collect()
    assert {x.length: x.n_docs for x in rows} == Counter(lens)
    for x in rows:
        assert (x.docs_ge, x.tokens_ge, x.docs_le) == (sum(n >= x.length for n in lens), sum(n for n in lens if n >= x.length), sum(n <= x.length for n in lens))
        assert (x.truncated_tokens, x.lost_tokens, x.n_total, x.total_tokens) == (sum(min(n, x.length) for n in lens), sum(max(0, n - x.length) for n in lens), len(lens), sum(lens))


def test_op4(spark, folder):
    out = by_id(queries.op4_simhash(spark, folder[0]))
    own = {i: slow_fingerprint(t) for i, t in folder[1].items()}
    assert {i: x.fingerprint for i, x in out.items()} == {i: f"{f:016x}" for i, f in own.items()}
    least = least_reachable(own.values(), 2)
    first = {}
    for i, f in sorted(own.items()):
        first.setdefault(least[f], i)
    assert {i: x.component_id for i, x in out.items()} == {i: first[least[f]] for i, f in own.items()}


def test_op5(spark, folder):
    out = by_id(queries.op5_language_id(spark, folder[0]))
    assert {i: x.held_out for i, x in out.items()} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in folder[1]}
    assert [out[i].lang_pred for i in (102, 103, 104)] == ["und"] * 3
    assert all(x.lang_pred in ("en", "xx", "yy", "und") and 0 <= x.score <= 1 for x in out.values())
    assert sum(out[i].lang_pred == ("en", "xx", "yy")[i % 3] for i in range(42)) >= 40


def test_op6(spark, folder):
    out = {x.conv_id: x for x in queries.op6_preference_format(spark, folder[0]).collect()}
    talk = {c: [(("user", "assistant")[t % 2], f"text {c // 2} {t}") for t in range(1 + c % 4)] for c in range(9)}
    show = lambda turns: "".join(f"<|{role}|>\n{text}<|end|>\n" for role, text in turns)

    def mask(turns):
        at, spans = 0, []
        for role, text in turns:
            start = at + len(f"<|{role}|>\n")
            at += len(show([(role, text)]))
            spans += [f"{start}-{at}"] if role == "assistant" else []
        return ",".join(spans)

    assert out.keys() == talk.keys()
    for c, turns in talk.items():
        other = list(turns)
        if c % 4 == 0:
            said = [k for k, (role, _) in enumerate(turns) if role == "assistant"]
            other = [(role, text[: len(text) // 2] if said and k == said[-1] else text) for k, (role, text) in enumerate(turns)]
        elif c % 4 == 1:
            other = turns[:-1]
        elif c % 4 == 2:
            other = [*turns, turns[-1]]
        else:
            other = talk.get(c + 1, [])
        n = 0
        while n < min(len(turns), len(other)) and turns[n] == other[n]:
            n += 1
        x = out[c]
        assert (x.prompt_turns, x.prompt, x.chosen, x.rejected, x.chosen_mask, x.rejected_mask) == (n, show(turns[:n]), show(turns[n:]), show(other[n:]), mask(turns[n:]), mask(other[n:]))


def test_op7(spark, folder):
    items = [tuple(x) for x in queries.table(spark, folder[0], "benchmark").collect()]
    out = by_id(queries.op7_decontamination(spark, folder[0]))
    assert out.keys() == folder[1].keys()
    for i, t in folder[1].items():
        if i == 110:
            assert not out[i].contaminated
            continue
        n, hit, found = brute_hits(t, items, 13)
        digest = sha(",".join(sorted(map(str, found))).encode())
        assert (out[i].n_words, out[i].n_hit, out[i].n_items, out[i].items_sha256, out[i].contaminated) == (n, len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= n)
    assert out[106].contaminated and out[106].n_items == 2


def test_op9(spark, folder):
    out = queries.op9_url_list(spark, folder[0]).collect()
    assert len(out) == 20 and {"page_id", "host", "fetched", "blocked", "blocked_by", "blocked_since"} == set(out[0].asDict())


def test_op10(spark, folder):
    out = by_id(queries.op10_suffix_dedup(spark, folder[0]))
    want = {i: (n, sum(b - a for a, b in spans), len(spans), sha(kept)) for i, n, spans, kept in brute_repeats(list(folder[1].items()), 100)}
    assert {i: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for i, x in out.items()} == want


def test_pipeline_on_repeated_and_missing_ids(spark, folder, tmp_path):
    r = random.Random(5)
    text = {k: prose(r, 60) for k in "abcd"}
    rows = [(1, text["a"]), (1, text["a"]), (1, text["b"]), (None, text["c"]), (None, text["c"]), (None, text["d"]), (4, text["d"]), (5, None)]
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(x.doc_id), x.decoded_sha256) for x in out) == sorted([("1", sha(text["a"].encode())), ("1", sha(text["b"].encode())), ("None", sha(text["c"].encode())), ("4", sha(text["d"].encode()))])
