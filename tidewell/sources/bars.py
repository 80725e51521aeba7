"""Bars: symbol, bar_index, time, time_ms, open, high, low, close, volume.

Every source normalises to this schema: NaN becomes NULL (na), bars are numbered per
symbol in time order, and ties in time are broken by a stated column.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PRICES = ("open", "high", "low", "close", "volume")
SCHEMA = "symbol string, bar_index long, time timestamp, time_ms long, open double, high double, low double, close double, volume double"


def number(x: Column) -> Column:
    """As double, with NaN as NULL."""
    x = x.cast("double")
    return F.when(~F.isnan(x), x)


def numbered(df: DataFrame) -> DataFrame:
    """bar_index from 0 per symbol, by time_ms."""
    by = Window.partitionBy("symbol").orderBy("time_ms")
    return df.withColumn("bar_index", (F.row_number().over(by) - 1).cast("long"))


def from_events(events: DataFrame, symbol: Column, time: Column, value: Column, unit: str = "hour", volume: Column | None = None, tie: Column | None = None) -> DataFrame:
    """One bar per symbol and unit of time: first, greatest, least and last value, and summed volume (rows counted if None).

    Rows without a time or value are left out.  Equal times are ordered by ``tie``.
    """
    rows = events.select(symbol.cast("string").alias("symbol"), time.cast("timestamp").alias("t"), number(value).alias("v"), (F.lit(1.0) if volume is None else number(volume)).alias("n"), (F.lit(0) if tie is None else tie).alias("tie"))
    rows = rows.where("t is not null and v is not null").withColumn("time", F.date_trunc(unit, "t"))
    at = F.struct("t", "tie")
    out = rows.groupBy("symbol", "time").agg(F.min_by("v", at).alias("open"), F.max("v").alias("high"), F.min("v").alias("low"), F.max_by("v", at).alias("close"), F.sum("n").alias("volume"))
    return numbered(out.withColumn("time_ms", F.unix_millis("time"))).select(*_names())


def _names() -> list[str]:
    return [c.split()[0] for c in SCHEMA.split(", ")]


def from_table(df: DataFrame, symbol: Column | None = None, time_ms: Column | None = None, order: Column | None = None) -> DataFrame:
    """A table that has the price columns. Without a time channel, time and time_ms are 0 and ``order`` numbers the bars; a missing volume is 0."""
    names = set(df.columns)
    rows = df.select(
        (F.lit("") if symbol is None else symbol.cast("string")).alias("symbol"),
        (F.lit(0) if time_ms is None else time_ms).cast("long").alias("time_ms"),
        (time_ms if order is None else order).alias("__order"),
        *[number(F.col(c)).alias(c) if c in names else F.lit(0.0).alias(c) for c in PRICES],
    )
    by = Window.partitionBy("symbol").orderBy("__order")
    out = rows.withColumn("bar_index", (F.row_number().over(by) - 1).cast("long")).withColumn("time", F.timestamp_millis("time_ms"))
    return out.select(*_names())


def from_arrays(spark: SparkSession, data: dict[str, list], symbol: str = "") -> DataFrame:
    """Bars of equally long lists open, high, low, close, and optionally volume and time (epoch ms)."""
    n = len(data["close"])
    if any(len(data[c]) != n for c in data if c in (*PRICES, "time")):
        raise ValueError("lists differ in length")
    rows = [(i, *[None if (x := data.get(c, [0.0] * n)[i]) is None else float(x) for c in PRICES], int(data["time"][i]) if "time" in data else 0) for i in range(n)]
    df = spark.createDataFrame(rows, "i long, open double, high double, low double, close double, volume double, t long")
    return from_table(df, F.lit(symbol), F.col("t"), F.col("i"))


def from_json(spark: SparkSession, path: str, symbol: str = "") -> DataFrame:
    """Bars of a JSON object of arrays. A missing volume is 0; missing times are days from 2020-01-01 UTC."""
    raw = spark.read.option("multiLine", True).json(path)
    names = [c for c in (*PRICES, "time") if c in raw.columns]
    rows = raw.select(F.posexplode(F.arrays_zip(*names)).alias("i", "x")).select("i", "x.*")
    time = F.col("time") if "time" in names else F.lit(1_577_836_800_000) + F.col("i") * 86_400_000
    return from_table(rows, F.lit(symbol), time, F.col("i"))


def read(spark: SparkSession, path: str, kind: str = "parquet", symbol: str | None = None, time_ms: str | None = None, order: str | None = None, **options) -> DataFrame:
    """Bars of a Parquet, ORC, CSV or JSON-lines table with price columns."""
    df = spark.read.format(kind).options(**({"header": True} if kind == "csv" else {}) | options).load(path)
    col = lambda c: None if c is None else F.col(c)
    return from_table(df, col(symbol), col(time_ms), col(order) if order else col(time_ms))


#: Multiplier, increment and mask of the command line's made-up bars, and their first seed and price.
WALK = (1103515245, 12345, 0x7FFFFFFF, 12345, 100.0)


def walk(n: int) -> dict[str, list]:
    """The command line's made-up daily bars, as lists: the same for all runs. The product of the generator is rounded to a double."""
    times, plus, mask, seed, price = WALK
    out: dict[str, list] = {c: [] for c in (*PRICES, "time")}

    def draw() -> float:
        nonlocal seed
        seed = int(float(seed) * times + plus) & mask
        return seed / mask

    for i in range(n):
        before = price
        price *= 1 + (draw() - 0.5) * 0.04
        top, bottom = max(before, price) * (1 + draw() * 0.01), min(before, price) * (1 - draw() * 0.01)
        for name, x in zip(out, (before, top, bottom, price, math.floor(1000 + draw() * 9000 + 0.5), 1_577_836_800_000 + i * 86_400_000), strict=True):
            out[name].append(x)
    return out


def synthetic(spark: SparkSession, symbols: int = 1, bars: int = 100, seed: int = 1, step_ms: int = 86_400_000, start_ms: int = 1_577_836_800_000) -> DataFrame:
    """Deterministic bars for trials, made where they are used: sums of hashed moves around 100."""
    rows = spark.range(symbols * bars).select((F.col("id") % symbols).cast("string").alias("symbol"), F.floor(F.col("id") / symbols).alias("i"))
    noise = lambda k: F.pmod(F.xxhash64("symbol", "i", F.lit(seed), F.lit(k)), F.lit(10_000)) / 10_000.0
    by = Window.partitionBy("symbol").orderBy("i")
    rows = rows.withColumn("move", noise(1) - 0.5).withColumn("close", 100 + F.sum("move").over(by))
    rows = rows.withColumn("open", F.coalesce(F.lag("close").over(by), F.lit(100.0)))
    rows = rows.withColumn("high", F.greatest("open", "close") + noise(2)).withColumn("low", F.least("open", "close") - noise(3)).withColumn("volume", 1000 + F.floor(1000 * noise(4)).cast("double"))
    return from_table(rows.withColumn("t", F.lit(start_ms) + F.col("i") * step_ms), F.col("symbol"), F.col("t"))


def built_in(bars: DataFrame) -> DataFrame:
    """Bars with the derived per-bar columns: hl2, hlc3, ohlc4, hlcc4, last_bar_index, time_close, last_bar_time, time_tradingday, calendar fields, barstate and session flags."""
    o, h, low, c, ms = (F.col(x) for x in ("open", "high", "low", "close", "time_ms"))
    every, by = Window.partitionBy("symbol"), Window.partitionBy("symbol").orderBy("bar_index")
    after, before = F.lead("time_ms").over(by), F.lag("time_ms").over(by)
    field = lambda f: F.when(ms == 0, F.lit(0)).otherwise(f("time")).cast("int")
    last = F.max("bar_index").over(every)
    first, islast = F.col("bar_index") == 0, F.col("bar_index") == F.col("last_bar_index")
    out = bars.withColumns(
        {
            "hl2": (h + low) / 2,
            "hlc3": (h + low + c) / 3,
            "ohlc4": (o + h + low + c) / 4,
            "hlcc4": (h + low + c + c) / 4,
            "last_bar_index": last,
            "last_bar_time": F.max("time_ms").over(every),
            "time_close": F.when(ms == 0, F.lit(0)).otherwise(F.coalesce(after, 2 * ms - before, ms)),
            "time_tradingday": F.floor(ms / 86_400_000).cast("long") * 86_400_000,
            "year": field(F.year),
            "month": field(F.month),
            "dayofmonth": field(F.dayofmonth),
            "dayofweek": field(F.dayofweek),
            "weekofyear": field(F.weekofyear),
            "hour": field(F.hour),
            "minute": field(F.minute),
            "second": field(F.second),
        }
    )
    return out.withColumns(
        {
            "isfirst": first,
            "islast": islast,
            "ishistory": ~islast,
            "isrealtime": islast,
            "isnew": F.lit(True),
            "isconfirmed": F.lit(True),
            "islastconfirmedhistory": F.col("bar_index") == F.col("last_bar_index") - 1,
            "ismarket": F.lit(True),
            "ispremarket": F.lit(False),
            "ispostmarket": F.lit(False),
        }
    )
