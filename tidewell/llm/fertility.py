"""Quality rules from how public tokenisers fare on a text.

Each word is encoded by a byte-level BPE vocabulary, with a space before it, and by a piece
vocabulary with byte fallback, which marks the start of a word.  Of a text are measured: characters per token (first vocabulary), the share of
tokens that are fallback bytes (second), and the entropy of its token distribution in bits
(first).  Bands per script say what is rejected; the script is that of most of its letters.

A script's band comes from the corpus: its limits are percentiles over the documents that
pass the base and are rated good, or over all that pass the base where too few are rated.
Scripts with few documents have fixed bands.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.bpe import encoder
from tidewell.llm.caches import bounded, claim
from tidewell.llm.store import Scratch

SYMBOLS = "#*$%&|<>"
_SPACE = " \t\n\r\x0b\x0c"
#: Words a worker remembers the measures of.
CACHE = 700_000


@dataclass(frozen=True)
class Band:
    """A text is rejected outside [min_chars, max_chars] characters per token, above max_fallback, or below min_entropy bits."""

    min_chars: float
    max_chars: float
    max_fallback: float
    min_entropy: float


#: Share of the reference beyond each limit: three limits bind on most texts, so at most about 1 % of the reference is lost.
TAIL = 0.0025
#: Documents that a script's reference must have.
LEAST_DOCS = 100
#: Percentiles are taken over steps of this size, outer edges of which are the limits.
STEPS = 100
#: Of scripts without a reference, by the first word of a letter's Unicode name. Characters per token: more than where every letter
#: of an alphabet is a token (elsewhere half of those of a plain sentence), to twice those of a plain sentence, which the longest tokens exceed.
BANDS = {
    "LATIN": Band(1.3, 6.7, 0.25, 3.0),
    "CYRILLIC": Band(1.1, 4.1, 0.25, 3.0),
    "GREEK": Band(1.05, 3.2, 0.25, 3.0),
    "ARABIC": Band(1.02, 2.7, 0.25, 3.0),
    "HEBREW": Band(1.02, 2.9, 0.25, 3.0),
    "CJK": Band(0.45, 1.8, 0.4, 3.0),
    "HIRAGANA": Band(0.5, 2.3, 0.4, 3.0),
    "KATAKANA": Band(0.5, 2.3, 0.4, 3.0),
    "HANGUL": Band(0.42, 1.7, 0.4, 3.0),
}
#: The vocabularies may know no letter of any other script, so that clean text may be bytes alone: only the entropy binds.
OTHER = Band(0.2, 9.0, 1.0, 3.0)


def script(char: str) -> str:
    return unicodedata.name(char, "UNKNOWN").split(" ")[0].split("-")[0]


class _Words:
    """Measures of words: rows of arrays, so that a text's are sums over its words' rows."""

    def __init__(self, ranks_path: str, pattern: str, pieces_path: str):
        import sentencepiece

        self.bpe = encoder(ranks_path, pattern)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        self.is_byte = np.array([self.pieces.IsByte(i) for i in range(self.pieces.GetPieceSize())])
        self.scripts: list[str] = []
        self.script_at: dict[str, int] = {}
        self.char_script: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.zeros((CACHE, 4), np.int32)  # chars, tokens, pieces, bytes of them
        self.letters = np.zeros((CACHE, 2), np.int32)  # script and letters of it
        self.mixed: dict[int, list[tuple[int, int]]] = {}  # rows of words of several scripts: the further scripts
        self.begin, self.flat = np.zeros(CACHE + 1, np.int64), np.zeros(4 * CACHE, np.int32)

    def learn(self, new: list[str]) -> None:
        codes = self.bpe.encode_many([" " + w for w in new])
        n = len(self.at)
        for w, pieces in zip(new, self.pieces.encode(new, num_threads=1), strict=True):
            k = len(self.at)
            self.rows[k] = len(w), 0, len(pieces), np.count_nonzero(self.is_byte[pieces]) if len(pieces) >= 3 and not w.isascii() else sum(map(self.is_byte.__getitem__, pieces))
            if w.isascii():
                self.letters[k] = self._script("a"), len(w) if w.isalpha() else sum(map(str.isalpha, w))
            elif own := Counter(map(self._script, filter(str.isalpha, w))):
                self.letters[k], *more = own.items()
                if more:
                    self.mixed[k] = more
            self.at[w] = k
        lens = np.fromiter(map(len, codes), np.int64, len(codes)) // 4
        self.rows[n : n + len(new), 1] = lens
        self.begin[n + 1 : n + 1 + len(new)] = self.begin[n] + np.cumsum(lens)
        end = int(self.begin[n + len(new)])
        if end > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros(max(end, 2 * len(self.flat)) - len(self.flat), np.int32)))
        self.flat[int(self.begin[n]) : end] = np.frombuffer(b"".join(codes), "<i4")

    def _script(self, char: str) -> int:
        if char not in self.char_script:
            name = script(char)
            self.char_script[char] = self.script_at.setdefault(name, len(self.scripts))
            if self.char_script[char] == len(self.scripts):
                self.scripts.append(name)
        return self.char_script[char]

    def prepare(self, texts: list[list[str]]) -> None:
        new = set().union(*texts).difference(self.at) if texts else set()
        if len(self.at) + len(new) > CACHE:
            self.clear()
            new = set().union(*texts)
            if len(new) > CACHE:
                self.rows, self.letters, self.begin = np.zeros((len(new), 4), np.int32), np.zeros((len(new), 2), np.int32), np.zeros(len(new) + 1, np.int64)
        if new:
            self.learn(list(new))

    def measure(self, words: list[str]) -> tuple[int, int, float, float, float, str | None]:
        """Word characters, tokens, characters per token, fallback share, entropy and script."""
        if not words:
            return 0, 0, 0.0, 0.0, 0.0, None
        at = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        chars, tokens, pieces, fallen = self.rows[at].sum(axis=0, dtype=np.int64).tolist()
        own, times = np.unique(at, return_counts=True)
        lens = self.begin[own + 1] - self.begin[own]
        spot = np.repeat(self.begin[own] - np.concatenate(([0], np.cumsum(lens)[:-1])), lens) + np.arange(lens.sum())
        ids, back = np.unique(self.flat[spot], return_inverse=True)
        p = np.bincount(back, weights=np.repeat(times, lens)) / tokens
        mix = self.letters[at]
        letters = np.bincount(mix[:, 0], weights=mix[:, 1], minlength=len(self.scripts))
        if self.mixed:
            for k, n in zip(own.tolist(), times.tolist(), strict=True):
                for kind, more in self.mixed.get(k, ()):
                    letters[kind] += n * more
        most = min(self.scripts[i] for i in np.flatnonzero(letters == letters.max())) if letters.any() else None
        return chars, tokens, chars / tokens, fallen / max(1, pieces), float(-(p * np.log2(p)).sum()) + 0.0, most


@lru_cache(maxsize=2)
def _of_process(ranks_path: str, pattern: str, pieces_path: str) -> _Words:
    return _Words(ranks_path, pattern, pieces_path)


def _forget() -> None:
    _of_process.cache_clear()
    encoder.cache_clear()


def repeated_words(words: list, window: int = 3) -> int:
    """Words in windows that occur at least twice in the text, first occurrences included."""
    n = len(words)
    if n <= window:
        return 0
    grams = list(zip(*(words[i:] for i in range(window)), strict=False))
    seen, twice = set(), set()
    for g in grams:
        (twice if g in seen else seen).add(g)
    if not twice:
        return 0
    hit = np.zeros(n + 1, np.int64)
    at = np.fromiter((i for i, g in enumerate(grams) if g in twice), np.int64)
    np.add.at(hit, at, 1)
    np.add.at(hit, at + window, -1)
    return int((np.cumsum(hit)[:-1] > 0).sum())


def repeated_lines(text: str) -> int:
    """\\n-split lines with a word that equal an earlier line."""
    seen, out = set(), 0
    for line in text.split("\n"):
        if line.strip(_SPACE):
            out += line in seen
            seen.add(line)
    return out


#: White space to str.split that is part of a word here.
_MORE_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def _split(text: str) -> list[str]:
    return [w.decode() for w in text.encode().split()] if _MORE_SPACE.search(text) else text.split()


_OUT = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "n_tokens": "long", "chars_per_token": "double", "fallback_share": "double", "token_entropy": "double", "script": "string"}


def measure(docs: DataFrame, ranks_path: str, pattern: str, pieces_path: str, least_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, base counts, base_failed, and the measures, one row per input row."""
    some = docs.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("__text"))

    def counts(text: str, words: list[str], measures: _Words) -> tuple:
        chars, *rest = measures.measure(words)
        repeats = repeated_words(words)
        failed = len(words) < least_words or 100 * repeats > 50 * len(words)
        return len(words), chars, sum(map(text.count, SYMBOLS)), repeated_lines(text), repeats, failed, *rest

    def run(batches):
        claim(f"fertility {ranks_path} {pieces_path}", _forget)
        measures = _of_process(ranks_path, pattern, pieces_path)
        kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts, words, size = [], [], 0
                while at + len(texts) < batch.num_rows and size < 300_000 and len(texts) < 512:
                    texts.append(batch.column(1)[at + len(texts)].as_py() or "")
                    words.append(_split(texts[-1]))
                    size += len(words[-1])
                measures.prepare(words)
                rows = [counts(t, w, measures) for t, w in zip(texts, words, strict=True)]
                cols = [pa.array(c, kinds[k]) for c, k in zip(zip(*rows, strict=True), _OUT.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *cols], [id_col, *_OUT])
                at += len(texts)

    return bounded(some).mapInArrow(run, f"`{id_col}` {some.schema[0].dataType.simpleString()}, " + ", ".join(f"{k} {v}" for k, v in _OUT.items()))


def reference_bands(measured: DataFrame, tail: float = TAIL, least_docs: int = LEAST_DOCS) -> dict[str, Band]:
    """Bands of the scripts that have ``least_docs`` rows or more that pass the base, from histograms of the measures."""
    steps = [F.floor(F.col(c) * STEPS).cast("long") for c in ("chars_per_token", "fallback_share", "token_entropy")]
    rows = measured.where("not base_failed and script is not null").select("script", F.posexplode(F.array(*steps)).alias("kind", "step"))
    found: dict[str, list[dict[int, int]]] = {}
    for r in rows.groupBy("script", "kind", "step").agg(F.count(F.lit(1)).alias("n")).collect():
        found.setdefault(r.script, [{}, {}, {}])[r.kind][r.step] = r.n

    def edge(of: dict[int, int], upper: bool) -> float:
        beyond = tail * sum(of.values())
        for step in sorted(of, reverse=upper):
            beyond -= of[step]
            if beyond < 0:
                return (step + upper) / STEPS

    return {k: Band(edge(chars, False), edge(chars, True), edge(fallback, True), edge(entropy, False)) for k, (chars, fallback, entropy) in found.items() if sum(chars.values()) >= least_docs}


def assess(docs: DataFrame, ranks_path: str, pattern: str, pieces_path: str, bands: dict[str, Band] | None = None, other: Band = OTHER, least_words: int = 50, id_col: str = "doc_id", text_col: str = "text", good: DataFrame | None = None) -> DataFrame:
    """id_col, base counts, base_failed, kept, and the measures the verdict rests on.

    One row per input row; ids, null or repeated, are only carried; nothing else is read.
    A null or wordless text has zeros, no script, and fails the base.  ``kept`` is false if
    the base failed or the text lies outside its script's band.  Without ``bands`` they are
    those of the documents whose id is in ``good`` (its first column), else of all, else BANDS.
    """
    out = measure(docs, ranks_path, pattern, pieces_path, least_words, id_col, text_col)
    if bands is None:
        out = Scratch(docs.sparkSession, "fertility").keep(out, "measures")
        bands = BANDS | reference_bands(out)
        if good is not None:
            rated = good.select(F.col(good.columns[0]).alias("__good"))
            bands |= reference_bands(out.join(rated, F.col(id_col) == F.col("__good"), "left_semi"))
    band = F.lit(None)
    if bands:
        band = F.create_map(*[x for k, b in bands.items() for x in (F.lit(k), _limits(b))])[F.col("script")]
    band = F.coalesce(band, _limits(other))
    inside = F.col("chars_per_token").between(band[0], band[1]) & (F.col("fallback_share") <= band[2]) & (F.col("token_entropy") >= band[3])
    names = list(_OUT)
    at = names.index("base_failed") + 1
    return out.select(id_col, *names[:at], (~F.col("base_failed") & inside).alias("kept"), *names[at:])


def _limits(band: Band):
    return F.array(*[F.lit(float(x)) for x in (band.min_chars, band.max_chars, band.max_fallback, band.min_entropy)])
