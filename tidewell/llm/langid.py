"""Language identification by words first, backing off to ever shorter character n-grams.

A model holds, per language, log frequencies of words and of character n-grams of words
(with word ends marked).  A known word scores by its log frequencies.  For an unknown one,
each position scores by the longest known n-gram that starts there, and the word by the
mean over its positions.  A text's language has the largest sum over its words.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.caches import bounded, claim

#: Longest n-gram that unseen words fall back to.
LONGEST = 4
#: Texts per language that a model is fitted on, about.
SAMPLE = 1000
#: Words a worker remembers the scores of.
CACHE = 300_000
NONE = "und"
#: Words of texts that hold nothing beyond Latin Extended-B and general punctuation: no separate marks, and few numbers that are neither digits nor letters.
_PLAIN = re.compile(r"[^\W\d_\xb2\xb3\xb9\xbc-\xbe]+")
_BEYOND = re.compile("[^\x00-\u024f\u2000-\u206f]")


@lru_cache(maxsize=1)
def _lettered() -> re.Pattern:
    """A letter, and the letters and marks (accents, vowel signs) after it."""

    def ranges(kinds: str) -> str:
        out, start, last = [], None, None
        for c in chain(range(0x40000), range(0xE0000, 0xE1000)):  # the other planes have neither
            if unicodedata.category(chr(c))[0] in kinds:
                start, last = (c, c) if last is None or c > last + 1 else (start, c)
                out[-1:] = [(start, c)] if out and out[-1][0] == start else [*out[-1:], (start, c)]
        return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)

    return re.compile(f"[{ranges('L')}][{ranges('LM')}]*")


def words(text: str | None) -> list[str]:
    """Runs of letters with their marks, in lower case."""
    if not text:
        return []
    text = text.lower()
    return (_lettered() if _BEYOND.search(text) else _PLAIN).findall(text)


def grams(word: str, n: int) -> list[str]:
    """n-grams of a word; those longer than one character see its ends."""
    marked = f"^{word}$" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


class Model:
    """Per-language log frequencies. Languages are sorted, so that ties go to the first."""

    def __init__(self, langs: list[str], counts: dict[tuple[int, str], dict[str, int]]):
        """counts: (kind, item) -> language -> count; kind 0 is words, n > 0 is n-grams."""
        self.langs = sorted(langs)
        place = {x: i for i, x in enumerate(self.langs)}
        self.tables: list[dict[str, int]] = []  # item -> row of the kind's matrix
        self.rows: list[np.ndarray] = []
        for kind in range(LONGEST + 1):
            own = [(item, of) for (k, item), of in counts.items() if k == kind]
            matrix = np.zeros((len(own), len(self.langs)))
            for row, (_, of) in enumerate(own):
                for lang, n in of.items():
                    matrix[row, place[lang]] = n
            total = matrix.sum(axis=0) + 0.5 * (len(own) + 1)
            self.tables.append({item: row for row, (item, _) in enumerate(own)})
            self.rows.append(np.log((matrix + 0.5) / total).astype(np.float32))
        self.unknown = np.full(len(self.langs), -20.0, np.float32)
        self._scorer = None

    def scorer(self) -> _Scorer:
        """Of this process; it remembers words' scores."""
        self._scorer = self._scorer or _Scorer(self)
        claim(f"langid {id(self)}", self.forget)
        return self._scorer

    def forget(self) -> None:
        self._scorer = None

    def word(self, word: str) -> np.ndarray:
        known = self.tables[0].get(word)
        if known is not None:
            return self.rows[0][known]
        marked, total = f"^{word}$", np.zeros(len(self.langs), np.float32)
        for i in range(1, len(word) + 1):
            for n in range(LONGEST, 0, -1):
                # longer grams may begin at the word's start mark
                gram = marked[i - 1 : i - 1 + n] if n > 1 else marked[i]
                found = self.tables[n].get(gram) if len(gram) == n else None
                if found is not None:
                    total += self.rows[n][found]
                    break
            else:
                total += self.unknown
        return total / len(word)


def _sampled(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int) -> DataFrame:
    """Text and language of about ``sample`` documents per language, chosen by a hash of their id."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    share = {r.lang: min(1.0, sample / r.n) for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not share:
        return rows.select("text", "lang")
    of = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])
    return rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < of[F.col("lang")] * F.lit(float(1 << 30))).select("text", "lang")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, seen: int = 2) -> Model:
    """A model from documents with a language.

    Fitted on about ``sample`` whole texts per language, so what reaches the driver does
    not grow with the corpus.  Words and n-grams are known if they occur ``seen`` times or
    more.  Rows without text or language are left out; no rows give a model without languages.
    """

    def count(batches):
        claim("langid fit")
        total: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                total[lang].update(words(text.as_py()))
        for lang, own in total.items():
            of = Counter({(0, w): n for w, n in own.items()})
            for w, c in own.items():
                for n in range(1, LONGEST + 1):
                    for g in grams(w, n):
                        of[n, g] += c
            items = list(of.items())
            for at in range(0, len(items), 50_000):
                some = items[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array([k for (k, _), _ in some], pa.int32()), pa.array([i for (_, i), _ in some]), pa.array([n for _, n in some], pa.int64())], ["lang", "kind", "item", "n"])

    sums = bounded(_sampled(docs, id_col, text_col, lang_col, sample)).mapInArrow(count, "lang string, kind int, item string, n long").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")).where(F.col("n") >= seen)
    counts: dict[tuple[int, str], dict[str, int]] = defaultdict(dict)
    langs = set()
    for lang, kind, item, n in sums.toPandas().itertuples(index=False):
        counts[kind, item][lang] = n
        langs.add(lang)
    return Model(sorted(langs), counts)


class _Scorer:
    def __init__(self, model: Model):
        self.model, self.at = model, {}
        self.rows = np.zeros((CACHE, len(model.langs)), np.float32)

    def predict(self, text: str | None) -> tuple[str, float]:
        found = words(text)
        if not found or not self.model.langs:
            return NONE, 0.0
        total = np.zeros(len(self.model.langs), np.float64)
        for start in range(0, len(found), CACHE // 2):
            some = found[start : start + CACHE // 2]
            new = set(some).difference(self.at)
            if len(self.at) + len(new) > CACHE:
                self.at, new = {}, set(some)
            for w in new:
                self.rows[len(self.at)] = self.model.word(w)
                self.at[w] = len(self.at)
            total += self.rows[np.fromiter(map(self.at.__getitem__, some), np.int64, len(some))].sum(axis=0, dtype=np.float64)
        best = int(total.argmax())
        return self.model.langs[best], float(1 / np.exp(np.minimum(total - total[best], 0)).sum())


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred (``und`` if the text is null or has no letter), score (the posterior of lang_pred; 0 for ``und``).

    One row per input row; ids, null or repeated, are only carried; nothing else is read.
    A text is held whole by the task that scores it.  Equal scores go to the first language
    by name.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    some = docs.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("__text"))

    def run(batches):
        scorer = held.value.scorer()
        for batch in batches:
            out = [scorer.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in out], pa.string()), pa.array([s for _, s in out], pa.float64())], [id_col, "lang_pred", "score"])

    return bounded(some).mapInArrow(run, f"`{id_col}` {some.schema[0].dataType.simpleString()}, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, least: float = 0.5, languages: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """docs whose language is one of ``languages`` (any if None) with a score of ``least`` or more.

    Null texts and those without letters go.  Columns stay as they are, whatever their names;
    only text_col goes through Python.  Repeated rows are judged alike.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def keep(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = held.value.scorer()
        for texts in batches:
            found = (scorer.predict(t.as_py()) for t in texts)
            yield pa.array([x != NONE and s >= least and (languages is None or x in languages) for x, s in found], pa.bool_())

    return bounded(docs).where(keep(F.col(f"`{text_col}`").cast("string")))
