"""Quality classifier: ordinal regression with cumulative links on graded ratings.

One weight vector over hashed words and word pairs is shared by all grades; ordered
thresholds turn a text's score s into P(grade > k) = sigmoid(s - threshold k).  Their sum
is the expected grade, and the one at the wanted grade is the tail probability that
selection goes by.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidewell.llm.caches import bounded, claim

#: Hash buckets of words and word pairs.
BUCKETS = 1 << 18
#: Rated texts that a model is fitted on, about.
SAMPLE = 6000
#: Words a worker remembers the hashes of.
CACHE = 400_000
_TO_SPACE = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one fewer than grades

    def tails(self, score: float) -> np.ndarray:
        """P(grade > k) for each k but the last."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - score, -50, 50)))


class Features:
    """Hashed word and word-pair counts of a text, as log counts of length one."""

    def __init__(self, buckets: int):
        self.buckets, self.seen = buckets, {}

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = text.encode().lower().translate(_TO_SPACE).split() if text else []
        if not words:
            return np.zeros(0, np.int64), np.zeros(0)
        if len(self.seen) > CACHE:
            self.seen = {}
        for w in set(words).difference(self.seen):
            self.seen[w] = xxh64_intdigest(w)
        h = np.fromiter(map(self.seen.__getitem__, words), np.uint64, len(words))
        pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:]) * np.uint64(0xBF58476D1CE4E5B9)
        at, n = np.unique((np.concatenate((h, pairs)) >> np.uint64(20)) % np.uint64(self.buckets), return_counts=True)
        value = np.log1p(n)
        return at.astype(np.int64), value / np.sqrt((value**2).sum())


def optimise(at: np.ndarray, value: np.ndarray, ends: np.ndarray, grade: np.ndarray, grades: int, buckets: int, rounds: int = 150, ridge: float = 2e-6, rate: float = 0.3) -> Model:
    """Least mean negative log likelihood with a ridge, by full-batch Adam; thresholds are a first one and positive steps.

    Grades weigh alike: each row counts by the inverse of its grade's share.
    """
    row = np.repeat(np.arange(len(grade)), np.diff(np.concatenate(([0], ends))))
    share = np.bincount(grade, minlength=grades)
    weigh = 1 / np.maximum(share, 1)[grade]
    weigh /= weigh.sum()
    beyond = np.cumsum((share / share.sum())[::-1])[::-1][1:].clip(1e-3, 1 - 1e-3)
    start = np.sort(-np.log(beyond / (1 - beyond)))
    steps = np.log(np.maximum(np.diff(start), 1e-2))
    x = np.concatenate((np.zeros(buckets), start[:1], steps))
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, rounds + 1):
        w, cut = x[:buckets], np.cumsum(np.concatenate((x[buckets : buckets + 1], np.exp(x[buckets + 1 :]))))
        score = np.bincount(row, weights=value * w[at], minlength=len(grade))
        below = np.concatenate((np.zeros((len(grade), 1)), 1 / (1 + np.exp(np.clip(score[:, None] - cut, -50, 50))), np.ones((len(grade), 1))), axis=1)
        slope = below * (1 - below)
        one = np.arange(len(grade))
        p = np.maximum(below[one, grade + 1] - below[one, grade], 1e-12)
        up, down = slope[one, grade + 1] / p, slope[one, grade] / p
        g_score = weigh * (up - down)  # of the negative log likelihood
        g_cut = np.array([(weigh * ((grade == k + 1) * down - (grade == k) * up)).sum() for k in range(grades - 1)])
        tail = np.cumsum(g_cut[::-1])[::-1]
        g = np.concatenate((np.bincount(at, weights=value * g_score[row], minlength=buckets) + ridge * w, tail[:1], tail[1:] * np.exp(x[buckets + 1 :])))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return Model(x[:buckets].astype(np.float32), np.cumsum(np.concatenate((x[buckets : buckets + 1], np.exp(x[buckets + 1 :])))))


def fit(docs: DataFrame, ratings: DataFrame, grades: int, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", sample: int = SAMPLE, buckets: int = BUCKETS, **options) -> Model:
    """A model from ratings (id_col, grade_col 0 .. grades - 1) of documents.

    Fitted on the whole texts of about ``sample`` rated documents, chosen by a hash of
    their id: all the driver ever holds.  Null or unknown grades and null ids are left
    out; several ratings of a document all count.  Without ratings all scores are 0.
    """
    rated = ratings.select(F.col(id_col).alias("__id"), F.col(grade_col).cast("int").alias("__grade")).where(F.col("__id").isNotNull() & F.col("__grade").between(0, grades - 1))
    total = rated.count()
    few = rated.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) < min(1.0, sample / max(1, total)) * (1 << 30))
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).join(few, "__id").select("__text", "__grade")

    def run(batches):
        claim("ordinal")
        features = Features(buckets)
        for batch in batches:
            rows = [features(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([a.astype("<i4").tobytes() for a, _ in rows], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in rows], pa.binary())], ["grade", "at", "value"])

    got = bounded(texts).mapInArrow(run, "grade int, at binary, value binary").toPandas()
    got = got.assign(order=[xxh64_intdigest(a + bytes([g])) for a, g in zip(got["at"], got["grade"], strict=True)]).sort_values("order")
    if not len(got):
        return Model(np.zeros(buckets, np.float32), np.arange(grades - 1, dtype=float))
    at = np.frombuffer(b"".join(got["at"]), "<i4").astype(np.int64)
    value = np.frombuffer(b"".join(got["value"]), "<f4").astype(np.float64)
    return optimise(at, value, np.cumsum([len(a) // 4 for a in got["at"]]), got["grade"].to_numpy(np.int64), grades, buckets, **options)


def score(docs: DataFrame, model: Model, tail: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, expected_grade, tail_probability: P(grade >= tail), with ``tail`` from 1 to the highest grade.

    One row per input row; ids, null or repeated, are only carried; nothing else is read.
    A null or wordless text scores 0, so its probabilities are those of the thresholds.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    some = docs.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("__text"))

    def run(batches):
        claim("ordinal")
        own = held.value
        features = Features(len(own.weights))
        for batch in batches:
            tails = []
            for t in batch.column(1):
                at, value = features(t.as_py())
                tails.append(own.tails(float((own.weights[at] * value).sum())))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([float(x.sum()) for x in tails], pa.float64()), pa.array([float(x[tail - 1]) for x in tails], pa.float64())], [id_col, "expected_grade", "tail_probability"])

    return bounded(some).mapInArrow(run, f"`{id_col}` {some.schema[0].dataType.simpleString()}, expected_grade double, tail_probability double")
