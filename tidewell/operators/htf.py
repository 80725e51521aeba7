"""Higher timeframes: bars of longer periods, and their values joined back onto the chart's bars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.library import timeframe_minutes
from tidewell.operators.study import Study


def period_key(time: Column, tf: str) -> Column:
    """The same for times of one period, UTC: days, ISO weeks, months, else whole multiples of the timeframe."""
    text = tf.strip().upper()
    if text in ("W", "1W"):
        return F.unix_seconds(F.date_trunc("week", time))
    if text in ("M", "1M"):
        return F.unix_seconds(F.date_trunc("month", time))
    if timeframe_minutes(tf) == 1440:
        return F.unix_seconds(F.date_trunc("day", time))
    return F.floor(F.unix_seconds(time) / F.lit(int(timeframe_minutes(tf) * 60)))


def with_index(bars: DataFrame, tf: str, timed: bool | None = None) -> DataFrame:
    """bars with htf_index: a new one wherever the period differs from the bar before; by bar counts where there is no time.

    ``timed`` says whether the bars have times; if None that is looked up, symbol by symbol, in a pass that holds a symbol's bars.
    """
    by = Window.partitionBy("symbol").orderBy("bar_index")
    timed = F.max("time_ms").over(Window.partitionBy("symbol")) != 0 if timed is None else F.lit(timed)
    key = period_key(F.col("time"), tf)
    ratio = max(1, int(timeframe_minutes(tf)))
    change = F.coalesce(F.col("__key") != F.lag("__key").over(by), F.lit(False)).cast("long")
    out = bars.withColumn("__key", F.when(timed, key).otherwise(F.floor(F.col("bar_index") / ratio))).withColumn("__change", change)
    return out.withColumn("htf_index", F.sum("__change").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("__key", "__change")


def higher(bars: DataFrame, tf: str, timed: bool | None = None) -> DataFrame:
    """Bars of the longer timeframe, with time_close; bar_index is the period's."""
    rows = with_index(bars, tf, timed)
    i = F.col("bar_index")
    out = rows.groupBy("symbol", F.col("htf_index").alias("__i")).agg(
        F.min("time").alias("time"),
        F.min("time_ms").alias("time_ms"),
        F.min_by("open", i).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", i).alias("close"),
        F.sum("volume").alias("volume"),
    )
    by = Window.partitionBy("symbol").orderBy("bar_index")
    out = out.withColumnRenamed("__i", "bar_index")
    t = F.col("time_ms")
    return out.withColumn("time_close", F.coalesce(F.lead(t).over(by), 2 * t - F.lag(t).over(by), t))


def security(bars: DataFrame, tf: str, expressions: dict[str, Callable[[Study], Column] | str], lookahead: bool = False, gaps: bool = False, timed: bool | None = None) -> DataFrame:
    """bars with, per expression, its value on the longer timeframe.

    Expressions are columns of the longer bars or functions of a Study of them, so they run
    on the longer bars with their own windows.  Without lookahead a bar sees the last period
    that is over, and na in the first; with it the period it is in, whole.  With gaps only
    the first bar that sees a period shows it.
    """
    coarse = higher(bars, tf, timed)
    study = Study(coarse)
    values = {k: (F.col(e) if isinstance(e, str) else e(study)) for k, e in expressions.items()}
    shown = study.result(**{f"__v_{k}": v for k, v in values.items()}).select(F.col("symbol").alias("__s"), F.col("bar_index").alias("__h"), *[f"__v_{k}" for k in values])
    rows = with_index(bars, tf, timed)
    at = F.col("htf_index") if lookahead else F.col("htf_index") - 1
    by = Window.partitionBy("symbol").orderBy("bar_index")
    rows = rows.withColumn("__at", at).withColumn("__again", F.coalesce(F.lag("htf_index").over(by) == F.col("htf_index"), F.lit(False)))
    out = rows.join(shown, (F.col("symbol") == F.col("__s")) & (F.col("__at") == F.col("__h")), "left")
    value = lambda k: F.when(~F.col("__again"), F.col(f"__v_{k}")) if gaps else F.col(f"__v_{k}")
    return out.select(*[F.col(c) for c in bars.columns if c not in values], *[value(k).alias(k) for k in values])
