"""URL filtering by dated list entries: a temporal as-of join.

Entries say that from a time on a domain is listed, or no longer.  Per domain they become
validity intervals.  A capture is judged by the intervals of its host and of every parent
domain that hold at its fetch time; it is listed if any of them says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.names import fresh

#: Times of one domain that go to one task.
MOST = 1_000_000


def host_of(url: Column) -> Column:
    """Lower-case host of a URL, without user, port or a final dot; null if there is none."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)
    return F.nullif(F.regexp_replace(F.lower(found), r"\.$", ""), F.lit(""))


def domains_of(host: Column) -> Column:
    """The host and its parent domains, longest first."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def intervals(entries: DataFrame, domain_col: str = "domain", time_col: str = "since", listed_col: str = "listed") -> DataFrame:
    """domain, since, until (null: still), for the times at which a domain is listed.

    Of entries of one domain and time, one that lists wins.  Entries with a null domain or
    time are left out; a null listed_col counts as false.  Repeated entries change nothing.
    """
    rows = entries.select(F.lower(F.col(domain_col)).alias("domain"), F.col(time_col).alias("since"), F.coalesce(F.col(listed_col), F.lit(False)).alias("listed")).where("domain is not null and since is not null")
    once = rows.groupBy("domain", "since").agg(F.max("listed").alias("listed"))
    order = Window.partitionBy("domain").orderBy("since")
    return once.withColumn("until", F.lead("since").over(order)).where("listed").select("domain", "since", "until")


def evaluate(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched", domain_col: str = "domain", since_col: str = "since", listed_col: str = "listed", most: int = MOST) -> DataFrame:
    """captures with host, blocked (boolean), blocked_by (the longest listed domain) and blocked_since added.

    A capture without host or time is not blocked; an empty url has no host.  Each distinct
    host and time is judged once; equal keys are then joined back, which adaptive execution
    splits where they are many.  Every row stays, repeated ones too; columns of these four
    names are replaced, others are kept whatever their names.

    The as-of join merges the times asked about and the starts of intervals, domain by
    domain in the order of time; the last start before a time is the interval that may hold.
    A domain with more than ``most`` times is dealt out to several parts, each with all its
    intervals.
    """
    new = ["host", "blocked", "blocked_by", "blocked_since"]
    named = captures.drop(*new).withColumn("host", host_of(F.col(f"`{url_col}`")))
    by, at, best = fresh(named, "__host", "__time", "__best")
    asked = named.select("host", F.col(f"`{time_col}`").alias("time")).where("host is not null and time is not null").distinct()
    spans = intervals(entries, domain_col, since_col, listed_col)
    listed = spans.select("domain").distinct()
    tried = asked.select("host", "time", F.explode(domains_of(F.col("host"))).alias("domain")).join(listed, "domain", "left_semi")
    parts = tried.groupBy("domain").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("parts"))
    starts = spans.join(parts, "domain").select("domain", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("since").alias("time"), F.struct("since", "until").alias("span"), F.lit(None).cast("string").alias("host"))
    times = tried.join(parts, "domain").select("domain", F.pmod(F.xxhash64("host", "time"), F.col("parts")).cast("int").alias("part"), "time", F.lit(None).cast(starts.schema["span"].dataType).alias("span"), "host")
    order = Window.partitionBy("domain", "part").orderBy("time", F.col("host").isNotNull())  # starts before the times that equal them
    merged = starts.unionByName(times).withColumn("last", F.last("span", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    hits = merged.where(F.col("host").isNotNull() & F.col("last").isNotNull() & (F.col("last.until").isNull() | (F.col("time") < F.col("last.until"))))
    longest = F.max_by(F.struct("domain", F.col("last.since").alias("since")), F.length("domain"))
    verdict = hits.groupBy("host", "time").agg(longest.alias(best)).toDF(by, at, best)
    out = named.join(verdict, (F.col("host") == F.col(by)) & (F.col(f"`{time_col}`") == F.col(at)), "left")
    return out.select(*[F.col(f"`{c}`") for c in named.columns], F.col(best).isNotNull().alias("blocked"), F.col(best)["domain"].alias("blocked_by"), F.col(best)["since"].alias("blocked_since"))
