"""Exact length histogram: token counts that answer questions about every context limit.

Documents are counted by encoded length; suffix sums over the lengths then give, for
every limit L, how many documents and tokens lie beyond it and how many tokens are
left when each document is truncated to L.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.store import Scratch

#: Lengths a block of the suffix sums spans.
BLOCK = 256


def length_histogram(counts: DataFrame, count_col: str = "n_tokens") -> DataFrame:
    """length, n_docs: one row per length that occurs. Null lengths count as 0; no rows give no rows."""
    return counts.groupBy(F.coalesce(F.col(count_col), F.lit(0)).cast("long").alias("length")).agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """The histogram with, for each length L that occurs taken as the context limit:

    docs_ge, tokens_ge: documents of L tokens or more, and their tokens;
    docs_le: documents of L tokens or fewer, so docs_le / n_total is the quantile of L;
    truncated_tokens: tokens left when every document is cut to L;
    lost_tokens: tokens cut; n_total and total_tokens: of all documents.

    The histogram is written first, so that the corpus is read once.  Sums run within
    blocks of lengths first and over block totals second (one row per BLOCK lengths), so
    no task holds the whole histogram.  No rows give no rows.
    """
    hist = Scratch(hist.sparkSession, "lengths").keep(hist, "histogram")
    block = F.floor(F.col("length") / BLOCK)
    rows = hist.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("tokens"), block.alias("block"))
    sums = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    sums = sums.select(
        "block",
        F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d_later"),
        F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t_later"),
        F.sum("d").over(every).alias("n_total"),
        F.sum("t").over(every).alias("total_tokens"),
    )
    own = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    out = (
        rows.withColumn("d_own", F.sum("n_docs").over(own))
        .withColumn("t_own", F.sum("tokens").over(own))
        .join(sums, "block")
        .select(
            "length",
            "n_docs",
            (F.col("d_own") + F.col("d_later")).alias("docs_ge"),
            (F.col("t_own") + F.col("t_later")).alias("tokens_ge"),
            "n_total",
            "total_tokens",
        )
    )
    cut = F.col("total_tokens") - F.col("tokens_ge") + F.col("length") * F.col("docs_ge")
    return out.withColumn("docs_le", F.col("n_total") - F.col("docs_ge") + F.col("n_docs")).withColumn("truncated_tokens", cut).withColumn("lost_tokens", F.col("total_tokens") - cut)


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """limit, docs_over, truncated_tokens, lost_tokens for any limits, whether or not a document has that length. No lengths give nulls for tokens."""
    tokens = F.col("length") * F.col("n_docs")

    def answer(limit: int):
        over = F.col("length") > limit
        left = F.sum(F.when(over, F.col("n_docs") * limit).otherwise(tokens))
        return F.struct(F.lit(limit).cast("long").alias("limit"), F.coalesce(F.sum(F.when(over, F.col("n_docs"))), F.lit(0)).alias("docs_over"), left.alias("truncated_tokens"), (F.sum(tokens) - left).alias("lost_tokens"))

    return sums.agg(F.array(*[answer(int(x)) for x in limits]).alias("a")).select(F.inline("a"))


def quantiles(sums: DataFrame, of: list[float]) -> DataFrame:
    """q, length: the least length that at least a share q of the documents does not exceed."""
    pick = [F.min(F.when(F.col("docs_le") >= F.lit(float(q)) * F.col("n_total"), F.col("length"))) for q in of]
    return sums.agg(F.array(*[F.struct(F.lit(float(q)).alias("q"), p.alias("length")) for q, p in zip(of, pick, strict=True)]).alias("a")).select(F.inline("a"))
