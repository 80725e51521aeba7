"""Decontamination, language ID, ordinal quality, chat formatting and URL lists on small fixtures."""

import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewell.llm import chat, decontam, langid, ordinal, urllist


def brute_hits(text, items, n):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    words, hit, found = split(text), set(), set()
    for item, t in items:
        w = split(t)
        k = min(n, len(w))
        for j in range(len(w) - k + 1) if w else ():
            for i in range(len(words) - k + 1):
                if words[i : i + k] == w[j : j + k]:
                    hit.update(range(i, i + k))
                    found.add(item)
    return len(words), hit, sorted(found)


def test_contamination_equals_brute_force(spark):
    r = random.Random(3)
    pick = lambda n: " ".join(r.choice(["Alpha", "beta", "GAMMA", "dé", "x1", "y,z", "-"]) for _ in range(n))
    items = [(i, pick(r.randint(0, 9))) for i in range(12)] + [(50, None), (51, "beta"), (52, "beta")]
    docs = [(i, pick(r.randint(0, 30))) for i in range(60)] + [(None, None), (7, "")]
    docs += docs[3:6] + [(99, " ".join(["beta gamma"] * 3000 + ["dé", pick(2000)]))]  # repeated rows and a long text
    df = spark.createDataFrame([(i, t, "q") for i, t in docs], "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (10**6, 25):  # one set, and several merged
        out = decontam.contamination(df, bench, n=4, one_in=3, max_set_words=size).collect()
        got = sorted(((x.doc_id, x.n_words, x.n_hit, x["items"], x.contaminated, [p for s in x.spans for p in range(s["from"], s["to"])]) for x in out), key=str)
        want = []
        for i, t in docs:
            n, hit, found = brute_hits(t, items, 4)
            want.append((i, n, len(hit), found, len(hit) > 0 and 3 * len(hit) >= n, sorted(hit)))
        assert got == sorted(want, key=str)
        kept = decontam.decontaminate(df, bench, n=4, one_in=3, max_set_words=size).collect()
        assert len(kept) == sum(not w[4] for w in want) and {x["items"] for x in kept} == {"q"}
        cut = decontam.decontaminate(df, bench, n=4, one_in=3, remove="spans", max_set_words=size).collect()
        words = lambda t: len(decontam.words(t))
        assert sorted((str(x.doc_id), words(x.text)) for x in cut) == sorted((str(w[0]), w[1] - w[2] * w[4]) for w in want)
    named = bench.selectExpr("concat('i', item_id) as item_id", "text")
    of = {x.doc_id: x["items"] for x in decontam.contamination(df, named, n=4).collect()}
    assert all(of[w[0]] == sorted(f"i{k}" for k in w[3]) for w in want if w[0] not in (7, None))
    assert decontam.contamination(df.limit(0), bench).collect() == []
    assert decontam.decontaminate(df.limit(0), bench).columns == df.columns
    assert not any(x.contaminated for x in decontam.contamination(df, bench.limit(0)).collect())


def test_items_dealt_out_to_several_sets(spark):
    r = random.Random(4)
    items = [("p", " ".join(r.choice("abc") for _ in range(9))), ("q", "d e")]
    docs = [(i, " ".join(r.choice("abcd") for _ in range(25))) for i in range(30)] + [(31, "x d e")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    out = decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench, n=3, max_set_words=4).collect()
    want = [(i, *brute_hits(t, items, 3)) for i, t in docs]
    assert sorted((x.doc_id, x.n_words, x.n_hit, x["items"]) for x in out) == [(i, n, len(hit), found) for i, n, hit, found in want]


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(decontam._Rolling, "at", lambda self, total, starts, size: np.full(len(starts), 5, np.uint64))
    items = [("a", 2, [b"x", b"y", b"z"]), ("b", 2, [b"y", b"z"]), ("c", 1, [b"w"])]
    found = decontam.WindowSet(items)
    hit, of = found.scan([b"w", b"y", b"z", b"q", b"z", b"x", b"y"])
    assert hit.tolist() == [True, True, True, False, False, True, True] and [found.names[i] for i in of] == ["a", "b", "c"]


def test_removed_spans_keep_the_rest():
    assert decontam.remove_spans("One, two! Three four.", [(1, 3)]) == "One, !  four."
    assert decontam.remove_spans("é b", []) == "é b"


def langs(spark):
    r = random.Random(9)
    make = {"aa": "wug tov wugtov ogtu".split(), "bb": "zéli éza lizé zaé".split(), "cc": "mnopr prom nomr opr".split()}
    rows = [(i, " ".join(r.choice(make[k]) for _ in range(30)), k) for i, k in enumerate(r.choice(list(make)) for _ in range(200))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows


def test_language_id(spark):
    df, rows = langs(spark)
    model = langid.fit(df.where("doc_id % 5 <> 0"))
    asked = df.unionByName(spark.createDataFrame([(900, None, "aa"), (901, "12 ,.", None), (902, "wugwug tovog", None), (903, "", None)], "doc_id long, text string, lang string"))
    out = {r.doc_id: r for r in langid.predict(asked, model).collect()}
    assert all(out[i].lang_pred == k and 0.5 < out[i].score <= 1 for i, _, k in rows)
    assert [out[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "aa", "und"] and out[900].score == 0
    assert langid.accepted(asked, model, languages=["aa"]).count() == sum(k == "aa" for _, _, k in rows) + 1
    empty = langid.fit(df.limit(0))
    assert {r.lang_pred for r in langid.predict(df, empty).collect()} == {"und"}


def test_backoff_uses_the_longest_known_gram():
    model = langid.Model(["a", "b"], {(0, "cat"): {"a": 5}, (4, "^dog"): {"b": 9}, (1, "d"): {"a": 9}, (2, "xy"): {"a": 3}})
    assert model.word("cat").argmax() == 0 and model.word("dog").argmax() == 1


def test_words_are_letters_with_their_marks():
    assert langid.words("½ ² ① Ⅷ 12_3") == [] and langid.words("x² a_b É") == ["x", "a", "b", "é"]
    assert langid.words("हिन्दी भाषा") == ["हिन्दी", "भाषा"] and langid.words("e\u0301te\u0301 \u0301 שָׁלוֹם") == ["e\u0301te\u0301", "שָׁלוֹם"]


def slow_scores(counts, langs, text):
    """Sums of log frequencies by the definition, over a text's words."""
    sums = {(k, x): sum(of.get(x, 0) for (kind, _), of in counts.items() if kind == k) + 0.5 * (sum(kind == k for kind, _ in counts) + 1) for k in range(5) for x in langs}
    log = lambda k, item, x: math.log((counts[k, item].get(x, 0) + 0.5) / sums[k, x])
    out = dict.fromkeys(langs, 0.0)
    for w in langid.words(text):
        for x in langs:
            if (0, w) in counts:
                out[x] += log(0, w, x)
                continue
            total, padded = 0.0, "^" + w + "$"
            for at in range(len(w)):
                for n in (4, 3, 2, 1):
                    gram = w[at] if n == 1 else padded[at : at + n]
                    if len(gram) == n and (n, gram) in counts:
                        total += log(n, gram, x)
                        break
                else:
                    total -= 20
            out[x] += total / len(w)
    return out


def test_language_scores_equal_brute_force(spark):
    r = random.Random(2)
    letters = {"p": "abcde", "q": "cdefg", "r": "aeéñà"}
    word = lambda k: "".join(r.choice(letters[k]) for _ in range(r.randint(1, 6)))
    rows = [(i, " ".join(word(k) for _ in range(20)), k) for i, k in enumerate("pqr" * 20)]
    counts = {}
    for _, text, k in rows:
        for w in langid.words(text):
            for kind, item in [(0, w), *[(n, g) for n in range(1, 5) for g in langid.grams(w, n)]]:
                of = counts.setdefault((kind, item), {})
                of[k] = of.get(k, 0) + 1
    counts = {key: kept for key, of in counts.items() if (kept := {k: n for k, n in of.items() if n >= 2})}
    df = spark.createDataFrame([(i, t, k, "x", 1.0) for i, t, k in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    asked = [(1, "zzz ab"), (2, "abcdefgabc éé"), (2, "abcdefgabc éé"), (None, rows[4][1]), (5, " ".join(rows[i][1] for i in range(0, 60, 7)) * 40), (6, "½"), (7, None), (8, "ж")]
    out = langid.predict(spark.createDataFrame(asked, "doc_id long, text string"), langid.fit(df)).collect()
    assert len(out) == len(asked)
    texts = {i: t for i, t in asked}
    for x in out:
        if x.doc_id in (6, 7):
            assert (x.lang_pred, x.score) == ("und", 0.0)
            continue
        want = slow_scores(counts, "pqr", texts[x.doc_id])
        best = max("pqr", key=lambda k: (round(want[k], 3), -ord(k)))
        assert x.lang_pred == best, (x, want)
        assert abs(x.score - 1 / sum(math.exp(min(0.0, v - want[best])) for v in want.values())) < 1e-3


def loss(model, rows, ridge):
    """Mean negative log likelihood, grades weighing alike, with the ridge."""
    share = [sum(g == k for _, g in rows) for k in range(len(model.thresholds) + 1)]
    weight = sum(1 / share[g] for _, g in rows)
    total = 0.0
    for (at, value), g in rows:
        tails = [1.0, *(1 / (1 + math.exp(t - float((model.weights[at] * value).sum()))) for t in model.thresholds), 0.0]
        total -= math.log(max(1e-12, tails[g] - tails[g + 1])) / share[g] / weight
    return total + ridge / 2 * float((model.weights.astype(float) ** 2).sum())


def test_ordinal_fit_has_the_least_loss():
    r = np.random.default_rng(3)
    rows = []
    for _ in range(120):
        x = r.normal(size=3)
        rows.append(((np.arange(3), x), int(np.searchsorted([-0.7, 0.8], x[0] - 0.5 * x[1] + r.normal()))))
    rows += rows[:5]  # repeated rows count again
    at, value = np.concatenate([a for (a, _), _ in rows]), np.concatenate([v for (_, v), _ in rows])
    model = ordinal.optimise(at, value, np.arange(3, 3 * len(rows) + 1, 3), np.array([g for _, g in rows]), 3, 3, rounds=600, ridge=1e-2, rate=0.05)
    best = loss(model, rows, 1e-2)
    assert model.thresholds[0] < model.thresholds[1] and model.weights[0] > 0 > model.weights[1]
    for _ in range(100):
        other = ordinal.Model(model.weights + r.normal(size=3).astype(np.float32) * 0.1, np.sort(model.thresholds + r.normal(size=2) * 0.1))
        assert loss(other, rows, 1e-2) > best - 1e-5


def test_ordinal_features_and_scores_equal_brute_force(spark):
    buckets, mask = 64, (1 << 64) - 1
    text = "The cat, the CAT saw 2 dögs"
    words = re.findall(rb"[0-9a-z\x80-\xff]+", text.encode().lower())
    own = [xxhash.xxh64_intdigest(w) for w in words]
    keys = own + [((a * 0x9E3779B97F4A7C15 & mask) ^ b) * 0xBF58476D1CE4E5B9 & mask for a, b in zip(own, own[1:], strict=False)]
    count = {}
    for k in keys:
        count[(k >> 20) % buckets] = count.get((k >> 20) % buckets, 0) + 1
    size = math.sqrt(sum(math.log1p(n) ** 2 for n in count.values()))
    at, value = ordinal.Features(buckets)(text)
    assert dict(zip(at.tolist(), value.tolist(), strict=True)) == pytest.approx({k: math.log1p(n) / size for k, n in count.items()})
    model = ordinal.Model(np.linspace(-1, 1, buckets).astype(np.float32), np.array([-0.2, 0.4]))
    rows = [(1, text, 0.0), (1, text, 0.0), (None, None, 0.0), (3, "", 0.0), (4, "cat " * 60_000, 0.0)]
    out = ordinal.score(spark.createDataFrame(rows, "doc_id long, text string, expected_grade double"), model, tail=2).collect()
    s = sum(model.weights[k] * math.log1p(n) / size for k, n in count.items())
    p = lambda s: [1 / (1 + math.exp(t - s)) for t in model.thresholds]
    by = {}
    for x in out:
        by.setdefault(x.doc_id, []).append((x.expected_grade, x.tail_probability))
    assert len(out) == 5 and by[1] == [pytest.approx((sum(p(s)), p(s)[1]), abs=1e-6)] * 2 and by[None] == by[3] == [pytest.approx((sum(p(0)), p(0)[1]))]
    assert ordinal.score(spark.createDataFrame([], "doc_id long, text string"), model).collect() == []


def test_ordinal_regression(spark):
    r = random.Random(5)
    words = {0: ["vile", "nasty"], 1: ["plain", "okay"], 2: ["fine", "lovely"]}
    rows = [(i, " ".join(r.choice(words[g]) if r.random() < 0.3 else r.choice(["the", "of", "and"]) for _ in range(40)), g) for i, g in enumerate(r.choice([0, 1, 2]) for _ in range(300))]
    df = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    ratings = df.where("doc_id % 4 <> 0").select("doc_id", "grade").unionByName(spark.createDataFrame([(None, 1), (3, None), (4, 9)], "doc_id long, grade int"))
    model = ordinal.fit(df.select("doc_id", "text"), ratings, 3)
    assert np.all(np.diff(model.thresholds) > 0)
    out = {x.doc_id: x for x in ordinal.score(df.unionByName(spark.createDataFrame([(999, None, 0)], df.schema)), model, tail=1).collect()}
    held = [(i, g) for i, _, g in rows if i % 4 == 0]
    assert sum(round(out[i].expected_grade) == g for i, g in held) / len(held) > 0.9
    assert sum((out[i].tail_probability >= 0.5) == (g >= 1) for i, g in held) / len(held) > 0.95
    assert 0 <= out[999].tail_probability <= 1
    blank = ordinal.fit(df.select("doc_id", "text"), ratings.limit(0), 3)
    assert len({x.expected_grade for x in ordinal.score(df, blank).collect()}) == 1


def test_preferences(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "more"), (1, 3, "assistant", "longer"), (2, 0, "user", "only"), (3, 0, "assistant", None)]
    conv = chat.turns(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    out = {r.conv_id: r for r in chat.preferences(chat.cut_answers(conv), "turns", "rejected").collect()}
    a = out[1]
    assert a.prompt == "<|user|>\nhi<|end|>\n<|assistant|>\nhello<|end|>\n<|user|>\nmore<|end|>\n" and a.prompt_turns == 3
    assert a.chosen_text == "<|assistant|>\nlonger<|end|>\n" and a.rejected_text == "<|assistant|>\nlon<|end|>\n"
    assert [a.chosen_text[s["from"] : s["to"]] for s in a.chosen_spans] == ["longer<|end|>\n"]
    assert (out[2].chosen_text, out[2].prompt_turns, out[3].prompt_turns) == ("", 1, 1)
    turn = "array<struct<role:string,text:string>>"
    pairs = spark.createDataFrame([(1, [("user", "a"), ("assistant", "b")], [("user", "a")], "p"), (2, None, [("user", "z")], "q"), (3, [("user", "x")], [("user", "y")], "r")], f"id long, chosen {turn}, rejected {turn}, prompt string")
    got = {r.id: r for r in chat.preferences(pairs, prefix="f_").collect()}
    assert (got[1].f_prompt_turns, got[1].f_rejected_text, got[1].prompt) == (1, "", "p")
    assert (got[2].f_prompt_turns, got[2].f_chosen_text) == (0, "") and got[3].f_prompt == ""


def test_preferences_keep_columns_of_any_name(spark):
    turn = "array<struct<role:string,text:string>>"
    names = ["__chosen", "__N", "__rejected_rest", "prompt", "Prompt_turns"]
    pairs = spark.createDataFrame([([("user", "a")], [("user", "a"), ("assistant", "b")], 1, 2, 3, 4, 5)] * 2, f"chosen {turn}, rejected {turn}, " + ", ".join(f"{n} int" for n in names))
    out = chat.preferences(pairs).collect()
    assert [(x["__chosen"], x["__N"], x["__rejected_rest"], x.prompt_turns, x.prompt, x.chosen_text, x.rejected_text) for x in out] == [(1, 2, 3, 1, "<|user|>\na<|end|>\n", "", "<|assistant|>\nb<|end|>\n")] * 2
    assert chat.preferences(pairs, prefix="p_").columns == [*pairs.columns, "p_prompt_turns", "p_prompt", "p_chosen_text", "p_rejected_text", "p_chosen_spans", "p_rejected_spans"]
    assert chat.preferences(pairs.limit(0)).collect() == []


def judged(host, time, entries):
    """(longest listed domain, since) as of a time, by trying every entry."""
    best = None
    for domain in {d for d, _, _ in entries if d}:
        if host is not None and time is not None and (host == domain or host.endswith("." + domain)):
            dated = {}
            for d, since, on in entries:
                if d == domain and since is not None and since <= time:
                    dated[since] = dated.get(since, False) or bool(on)
            if dated and dated[max(dated)] and (best is None or len(domain) > len(best[0])):
                best = domain, max(dated)
    return best


@pytest.mark.parametrize("most", [7, 10**6])
def test_url_lists_equal_brute_force(spark, most):
    r = random.Random(most)
    entries = [("hot.org", r.randrange(4000), r.random() < 0.5) for _ in range(3000)] + [(r.choice(["a.hot.org", "b.net", "c.b.net", "net"]), r.randrange(4000), r.choice([True, False, None])) for _ in range(60)] + [(None, 3, True), ("d.io", None, True)]
    hosts = ["hot.org", "a.hot.org", "x.a.hot.org", "b.net", "z.c.b.net", "hot.org.uk", "d.io"]
    captures = [(i, "http://" + r.choice(hosts) + "/p", r.randrange(-5, 4005)) for i in range(400)] + [(900, None, 5), (901, "http://hot.org/", None), (902, "", 7)]
    captures += captures[:3]
    df = spark.createDataFrame([(*c, 1, 2) for c in captures], "id long, url string, fetched int, __time int, time int")
    out = urllist.evaluate(df, spark.createDataFrame(entries, "domain string, since int, listed boolean"), most=most).collect()
    assert len(out) == len(captures) and all(x["__time"] == 1 and x.time == 2 for x in out)
    known = {}
    for x in out:
        key = x.host, x.fetched
        if key not in known:
            known[key] = judged(x.host, x.fetched, entries)
        assert (x.blocked, x.blocked_by, x.blocked_since) == ((True, *known[key]) if known[key] else (False, None, None)), x


def test_url_lists(spark):
    entries = spark.createDataFrame([("bad.com", 10, True), ("bad.com", 20, False), ("Sub.bad.com", 15, True), ("bad.com", 20, False), (None, 1, True), ("tie.org", 5, False), ("tie.org", 5, True)], "domain string, since int, listed boolean")
    rows = [(1, "http://www.bad.com/x", 9), (2, "https://WWW.bad.com:80/", 10), (3, "http://bad.com", 20), (4, "http://a.sub.bad.com/", 25), (5, "http://notbad.com", 12), (6, None, 12), (7, "http://tie.org?q", 7), (8, "http://bad.com/", None), (2, "https://WWW.bad.com:80/", 10)]
    df = spark.createDataFrame([(i, u, t, "old") for i, u, t in rows], "id long, url string, fetched int, blocked string")
    out = urllist.evaluate(df, entries).collect()
    got = {r.id: (r.blocked, r.blocked_by, r.blocked_since) for r in out}
    assert len(out) == 9
    assert got == {1: (False, None, None), 2: (True, "bad.com", 10), 3: (False, None, None), 4: (True, "sub.bad.com", 15), 5: (False, None, None), 6: (False, None, None), 7: (True, "tie.org", 5), 8: (False, None, None)}
    assert urllist.evaluate(df, entries.limit(0)).where(F.col("blocked")).count() == 0
