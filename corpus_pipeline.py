"""Stages that turn raw documents into training tokens.

Each stage takes (spark, docs, sf_dir), where docs is all that its predecessor kept; all
but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import bpe, decontam, langid, simhash, suffix
from tidewell.llm.queries import RANKS, table
from tidewell.llm.store import Scratch


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a score of one half or more, by a model of their own languages.

    Null texts and texts without letters go.  Ids are only hashed, to leave a fifth out of
    training; a null id's document is not trained on.  Repeated rows all stay or all go.
    """
    training = docs.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    return langid.accepted(docs, langid.fit(training))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints (three-word shingles, two bits, as the operator's query): the one with the least id.

    Of repeated rows one stays; of rows without an id one per text, unless a linked one has an id.
    """
    return simhash.one_of_each(docs)


def repeat_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of strings that start earlier, n_chars counted anew; documents of which nothing is left go.

    Rows that share an id come one after the other; those without one come last.
    """
    return suffix.without_repeats(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not hold benchmark text; ids are not read."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each document's token ids and of the bytes they decode to, one row per row, ids only carried."""
    coded = bpe.encode_decode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("repeat_dedup", repeat_dedup),
    ("decontaminated", decontaminated),
    ("encoded", encoded),
]

#: SQL can express neither the tokeniser nor the fingerprints; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs, done = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        scratch.drop(*done)
        done = [docs]
        scratch.settle()
    return docs
