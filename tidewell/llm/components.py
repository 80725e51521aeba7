"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.store import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: each node hands its larger neighbours the least of its neighbourhood. Small: the same for its smaller neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.where("v < u")
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = near.join(least, "u")
    out = out.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else out.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root: the least node reachable, for each node of an edge table (u, v).

    No node's neighbours are gathered in one place: minima are partial aggregates, and
    what they are joined back to is two plain columns, which adaptive execution splits
    where one node has very many.  Each round is written, so a lost executor costs one
    round; rounds end when a round changes nothing.
    """
    now = scratch.keep(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        nxt = scratch.keep(_star(_star(now, True), False), "stars")
        seen = nxt.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(now)
        now = nxt
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
