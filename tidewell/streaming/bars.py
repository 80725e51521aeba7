"""Bars and series over streams.

Ticks become bars in event-time windows, which are emitted once closed; series operators
keep the same states per symbol as the batch scans do.
"""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SERIES = "symbol string, time timestamp, open double, high double, low double, close double, volume double"


def ticks_to_bars(ticks: DataFrame, symbol: Column, time: Column, value: Column, every: str = "1 hour", late: str = "1 hour", volume: Column | None = None, tie: Column | None = None) -> DataFrame:
    """symbol, time, open, high, low, close, volume; ticks later than ``late`` are left out. For append mode: a bar comes when its window is closed.

    Ticks of equal time are ordered by ``tie``, else by value, so that bars do not depend on how ticks arrive.
    """
    v = value.cast("double")
    rows = ticks.select(symbol.cast("string").alias("symbol"), time.cast("timestamp").alias("t"), v.alias("v"), (F.lit(1.0) if volume is None else volume.cast("double")).alias("n"), (v if tie is None else tie).alias("tie"))
    at = F.struct("t", "tie")
    out = rows.withWatermark("t", late).groupBy("symbol", F.window("t", every).alias("w")).agg(F.min_by("v", at).alias("open"), F.max("v").alias("high"), F.min("v").alias("low"), F.max_by("v", at).alias("close"), F.sum("n").alias("volume"))
    return out.select("symbol", F.col("w.start").alias("time"), "open", "high", "low", "close", "volume")


def sessions(ticks: DataFrame, symbol: Column, time: Column, value: Column, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """symbol, start, until, ticks, low, high of runs of ticks with no pause of ``gap`` or more. For append mode, as bars."""
    rows = ticks.select(symbol.cast("string").alias("symbol"), time.cast("timestamp").alias("t"), value.cast("double").alias("v"))
    out = rows.withWatermark("t", late).groupBy("symbol", F.session_window("t", gap).alias("w")).agg(F.count(F.lit(1)).alias("ticks"), F.min("v").alias("low"), F.max("v").alias("high"))
    return out.select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("until"), "ticks", "low", "high")


def drained(stream: DataFrame, name: str) -> DataFrame:
    """All that a stream has now, written to the session's shared folder and read back as a table."""
    spark = stream.sparkSession
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or "file://" + tempfile.mkdtemp(prefix="tidewell-")
    folder = f"{base.rstrip('/')}/stream-{name}-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").outputMode("append").option("path", folder + "/out").option("checkpointLocation", folder + "/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(folder + "/out")


def running(bars: DataFrame, *ops: tuple) -> DataFrame:
    """A stream of bars with a double column for every value of the operators (see ``operators.scan.op``).

    The bars are a stream of their own (the table that ``ticks_to_bars`` was written to):
    Spark does not put states of ours behind an aggregation of the same query.  A symbol's
    bars are taken in time order within a trigger; its states are kept between triggers.
    Bars that come after a later one of their symbol was taken are left out.
    """
    made = [n for _, _, _, names in ops for n in names]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.exists:
            blob, last = state.get
            steps = pickle.loads(blob)
        else:
            steps, last = [make() for make, _, _, _ in ops], -(2**63)
        rows = pd.concat(list(batches)).sort_values("time")
        rows = rows[rows["time"].astype("int64") > last]
        out: dict[str, list] = {n: [] for n in made}
        for row in rows.to_dict("records"):
            for step, (_, inputs, params, names) in zip(steps, ops, strict=True):
                args = [np.nan if row[c] is None else row[c] for c in inputs] + [row[p] if isinstance(p, str) else p for p in params]
                got = step.step(*args)
                for n, v in zip(names, got if len(names) > 1 else [got], strict=True):
                    out[n].append(v)
        if len(rows):
            last = int(rows["time"].astype("int64").max())
        state.update((pickle.dumps(steps), last))
        yield rows.assign(**{n: pd.array(v, dtype="float64") for n, v in out.items()})

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in bars.schema] + [f"`{n}` double" for n in made])
    return bars.groupBy("symbol").applyInPandasWithState(run, schema, "states binary, last long", "append", "NoTimeout")
