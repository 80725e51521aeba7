"""Registered queries of the bar engine, each with the SQL that gives the same rows.

Doubles are rounded to six decimals on both sides, with -0 made 0; na is NULL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import columns as C
from tidewell.operators import htf, scan
from tidewell.operators.study import Study
from tidewell.plans import script
from tidewell.sources import bars as B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Moves values off the ties of rounding, which sums in another order fall to either side of.
NUDGE = 3e-8

BARS = """bars AS (
  SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY time) - 1 AS bar_index, time, epoch_ms(time) AS time_ms, open, high, low, close, volume FROM (
    SELECT event_type AS symbol, date_trunc('hour', ts) AS time, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*)::DOUBLE AS volume
    FROM events WHERE ts IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2))"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return B.from_events(e, F.col("event_type"), F.col("ts"), F.col("value"), "hour", tie=F.col("event_id"))


def rounded(x: Column, places: int) -> Column:
    """Without the decimal numbers of ``round``, which cost more than most of what is rounded here."""
    return F.rint((x.cast("double") + F.lit(NUDGE)) * F.lit(10.0**places)) / F.lit(10.0**places) + F.lit(0.0)


def r6(x: Column) -> Column:
    return rounded(x, 6)


def _register(name: str, query, sql: str | None = None) -> None:
    query.__name__ = name
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


# -- windows in SQL -------------------------------------------------------------------------


def win(n: int | None = None, end: str = "CURRENT ROW") -> str:
    start = "UNBOUNDED" if n is None else n - 1
    return f"OVER (PARTITION BY symbol ORDER BY bar_index ROWS BETWEEN {start} PRECEDING AND {end})"


LINE = "OVER (PARTITION BY symbol ORDER BY bar_index)"


def full(x: str, n: int, sql: str) -> str:
    return f"CASE WHEN count({x}) {win(n)} = {n} THEN {sql} END"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) {LINE}"


def arr(x: str, n: int) -> str:
    return full(x, n, f"list({x}) {win(n)}")


def study(name: str, build: Callable[[Study], dict[str, Column]], columns: dict[str, str], stages: tuple[dict[str, str], ...] = (), whole: tuple[str, ...] = ()) -> None:
    """A query of series over hourly bars: what build gives, and its SQL; stages are columns that later ones rest on; ``whole`` are not doubles."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = Study(hourly(spark, sf_dir))
        made = build(s)
        out = s.result(**made)
        return out.select("symbol", F.col("bar_index").cast("long").alias("bar_index"), *[(F.col(c).cast("boolean") if k == "bool" else F.col(c).cast("long") if k == "long" else r6(F.col(c))).alias(c) for c in made for k in [kinds.get(c)]])

    kinds = {w.split(":")[0]: w.split(":")[1] for w in whole}
    sql, at = f"WITH {BARS}", "bars"
    for i, stage in enumerate(stages):
        sql += f", s{i} AS (SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in stage.items()) + f" FROM {at})"
        at = f"s{i}"
    sql += f", last_ AS (SELECT symbol, bar_index, " + ", ".join(f"{v} AS {k}" for k, v in columns.items()) + f" FROM {at})"
    sql += " SELECT symbol, bar_index::BIGINT AS bar_index, " + ", ".join(f"{c}::BOOLEAN AS {c}" if kinds.get(c) == "bool" else f"{c}::BIGINT AS {c}" if kinds.get(c) == "long" else f"round({c}::DOUBLE, 6) + 0.0 AS {c}" for c in columns) + " FROM last_"
    _register(name, query, sql)


def ramp(x: str, n: int) -> str:
    return f"(sum({x} * bar_index) {win(n)} - (bar_index - {n}) * sum({x}) {win(n)})"


def wma(x: str, n: int) -> str:
    return full(x, n, f"{ramp(x, n)} / {n * (n + 1) / 2}")


# -- sources --------------------------------------------------------------------------------


def bars_hourly(spark, sf_dir):
    return hourly(spark, sf_dir).select("symbol", "bar_index", "time_ms", "open", "high", "low", "close", "volume")


_register("bars_hourly", bars_hourly, f"WITH {BARS} SELECT symbol, bar_index::BIGINT AS bar_index, time_ms, open, high, low, close, volume FROM bars")


def bars_by_user(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return B.from_events(e, F.col("user_id"), F.col("ts"), F.col("value"), "day", tie=F.col("event_id")).select("symbol", "bar_index", "time_ms", "open", "high", "low", "close", "volume")


_register("bars_by_user", bars_by_user, "SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY time_ms) - 1 AS bar_index, time_ms, open, high, low, close, volume FROM (SELECT user_id::VARCHAR AS symbol, epoch_ms(date_trunc('day', ts)::TIMESTAMP) AS time_ms, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY 1, 2)")


def bars_daily_prices(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    out = B.from_events(rows, F.col("l_returnflag"), F.col("l_shipdate"), F.col("l_extendedprice"), "day", F.col("l_quantity"), F.struct("l_orderkey", "l_linenumber"))
    return out.select("symbol", "bar_index", "time_ms", "open", "high", "low", "close", r6(F.col("volume")).alias("volume"))


_register("bars_daily_prices", bars_daily_prices, "SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY time_ms) - 1 AS bar_index, time_ms, open, high, low, close, round(volume, 6) + 0.0 AS volume FROM (SELECT l_returnflag AS symbol, epoch_ms(date_trunc('day', l_shipdate)::TIMESTAMP) AS time_ms, arg_min(l_extendedprice, (l_shipdate, l_orderkey, l_linenumber)) AS open, max(l_extendedprice) AS high, min(l_extendedprice) AS low, arg_max(l_extendedprice, (l_shipdate, l_orderkey, l_linenumber)) AS close, sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2)")


def bars_built_in(spark, sf_dir):
    out = B.built_in(hourly(spark, sf_dir))
    return out.select("symbol", "bar_index", *[r6(F.col(c)).alias(c) for c in ("hl2", "hlc3", "ohlc4", "hlcc4")], F.col("last_bar_index").cast("long").alias("last_bar_index"), "time_close", "last_bar_time", "time_tradingday", *[F.col(c).cast("long").alias(c) for c in ("year", "month", "dayofmonth", "dayofweek", "weekofyear", "hour", "minute", "second")], "isfirst", "islast", "islastconfirmedhistory")


_register(
    "bars_built_in",
    bars_built_in,
    f"""WITH {BARS} SELECT symbol, bar_index::BIGINT AS bar_index, round((high + low) / 2, 6) + 0.0 AS hl2, round((high + low + close) / 3, 6) + 0.0 AS hlc3, round((open + high + low + close) / 4, 6) + 0.0 AS ohlc4, round((high + low + 2 * close) / 4, 6) + 0.0 AS hlcc4,
    (count(*) OVER (PARTITION BY symbol) - 1)::BIGINT AS last_bar_index, coalesce(lead(time_ms) {LINE}, 2 * time_ms - lag(time_ms) {LINE}, time_ms)::BIGINT AS time_close, max(time_ms) OVER (PARTITION BY symbol)::BIGINT AS last_bar_time, (time_ms // 86400000 * 86400000)::BIGINT AS time_tradingday,
    year(time) AS year, month(time) AS month, day(time) AS dayofmonth, dayofweek(time) + 1 AS dayofweek, weekofyear(time) AS weekofyear, hour(time) AS hour, minute(time) AS minute, second(time) AS second, bar_index = 0 AS isfirst, bar_index = count(*) OVER (PARTITION BY symbol) - 1 AS islast, bar_index = count(*) OVER (PARTITION BY symbol) - 2 AS islastconfirmedhistory FROM bars""",
)

# -- windowed ---------------------------------------------------------------------------------

study("ta_sma", lambda s: {"sma": s.sma("close", 14)}, {"sma": full("close", 14, f"avg(close) {win(14)}")})
study("ta_wma", lambda s: {"wma": s.wma("close", 10)}, {"wma": f"CASE WHEN len(w) = 10 THEN list_sum([x * i for x, i in w]) / 55 END"}, ({"w": f"list(close) {win(10)}"},))
study("ta_alma", lambda s: {"alma": s.alma("close", 9, 0.85, 6.0)}, {"alma": "CASE WHEN len(w) = 9 THEN list_sum([x * exp(-power(i - 1 - 6.8, 2) / 4.5) for x, i in w]) / list_sum([exp(-power(i - 6.8, 2) / 4.5) for i in range(9)]) END"}, ({"w": f"list(close) {win(9)}"},))
study("ta_hma", lambda s: {"hma": s.hma("close", 9)}, {"hma": f"CASE WHEN bar_index >= 10 THEN {ramp('d', 3)} / 6 END"}, ({"d": f"2 * {wma('close', 4)} - {wma('close', 9)}"},))
study("ta_swma", lambda s: {"swma": s.swma("close")}, {"swma": f"({lag('close', 3)} + 2 * {lag('close', 2)} + 2 * {lag('close')} + close) / 6"})
study("ta_vwma", lambda s: {"vwma": s.vwma("close", 12)}, {"vwma": full("close", 12, f"sum(close * volume) {win(12)} / nullif(sum(volume) {win(12)}, 0)")})
study("ta_ao", lambda s: {"ao": s.ao()}, {"ao": full("mid", 34, f"avg(mid) {win(5)} - avg(mid) {win(34)}")}, ({"mid": "(high + low) / 2"},))
study("ta_linreg", lambda s: {"linreg": s.linreg("close", 10, 0), "ahead": s.linreg("close", 10, 2)}, {c: full("close", 10, f"regr_intercept(close, bar_index) {win(10)} + regr_slope(close, bar_index) {win(10)} * (bar_index + {k})") for c, k in (("linreg", 0), ("ahead", 2))})
study("ta_variance_stdev", lambda s: {"variance": s.variance("close", 20), "stdev": s.stdev("close", 20), "sample": s.stdev("close", 20, False)}, {"variance": full("close", 20, f"var_pop(close) {win(20)}"), "stdev": full("close", 20, f"stddev_pop(close) {win(20)}"), "sample": full("close", 20, f"stddev_samp(close) {win(20)}")})
study("ta_dev", lambda s: {"dev": s.dev("close", 8)}, {"dev": "list_avg([abs(x - list_avg(w)) for x in w])"}, ({"w": arr("close", 8)},))
study("ta_bb", lambda s: dict(zip(("mid", "up", "low_"), s.bb("close", 20, 2.0), strict=True)), {"mid": "m", "up": "m + 2 * d", "low_": "m - 2 * d"}, ({"m": full("close", 20, f"avg(close) {win(20)}"), "d": full("close", 20, f"stddev_pop(close) {win(20)}")},))
study("ta_bbw", lambda s: {"bbw": s.bbw("close", 20, 2.0)}, {"bbw": "4 * d / nullif(m, 0) * 100"}, ({"m": full("close", 20, f"avg(close) {win(20)}"), "d": full("close", 20, f"stddev_pop(close) {win(20)}")},))
study("ta_cci", lambda s: {"cci": s.cci("close", 10)}, {"cci": "CASE WHEN d = 0 THEN 0 ELSE (close - list_avg(w)) / (0.015 * d) END"}, ({"w": arr("close", 10)}, {"d": "list_avg([abs(x - list_avg(w)) for x in w])"}))
study("ta_correlation", lambda s: {"correlation": s.correlation("close", "volume", 10)}, {"correlation": f"CASE WHEN bar_index >= 9 AND NOT isnan(c) THEN c END"}, ({"c": f"CASE WHEN var_pop(close) {win(10)} > 0 AND var_pop(volume) {win(10)} > 0 THEN corr(close, volume) {win(10)} END"},))
study("ta_change", lambda s: {"change": s.change("close"), "mom": s.mom("close", 5)}, {"change": f"close - {lag('close')}", "mom": f"close - {lag('close', 5)}"})
study("ta_roc", lambda s: {"roc": s.roc("close", 4)}, {"roc": f"100 * (close - {lag('close', 4)}) / nullif({lag('close', 4)}, 0)"})
study("ta_cmo", lambda s: {"cmo": s.cmo("close", 9)}, {"cmo": f"CASE WHEN bar_index >= 9 THEN CASE WHEN up + down = 0 THEN 0 ELSE 100 * (up - down) / (up + down) END END"}, ({"d": f"close - {lag('close')}"}, {"up": f"sum(greatest(d, 0)) {win(9)}", "down": f"sum(greatest(-d, 0)) {win(9)}"}))
study("ta_mfi", lambda s: {"mfi": s.mfi("close", 9)}, {"mfi": "CASE WHEN bar_index >= 9 THEN CASE WHEN down = 0 THEN 100 ELSE 100 - 100 / (1 + up / down) END END"}, ({"f": f"close * volume * sign(close - {lag('close')})"}, {"up": f"sum(greatest(f, 0)) {win(9)}", "down": f"sum(greatest(-f, 0)) {win(9)}"}))
study("ta_highest_lowest", lambda s: {"highest": s.highest("high", 10), "lowest": s.lowest("low", 10)}, {"highest": full("high", 10, f"max(high) {win(10)}"), "lowest": full("low", 10, f"min(low) {win(10)}")})
study("ta_highestbars_lowestbars", lambda s: {"highestbars": s.highestbars("high", 7), "lowestbars": s.lowestbars("low", 7)}, {"highestbars": "list_max([i - 7 for x, i in h if x = list_max(h)])", "lowestbars": "list_max([i - 7 for x, i in l if x = list_min(l)])"}, ({"h": arr("high", 7), "l": arr("low", 7)},), ("highestbars:long", "lowestbars:long"))
study("ta_range", lambda s: {"range_": s.range("close", 10)}, {"range_": full("close", 10, f"max(close) {win(10)} - min(close) {win(10)}")})
study("ta_stoch", lambda s: {"stoch": s.stoch("close", "high", "low", 14)}, {"stoch": "CASE WHEN t = b THEN 50 ELSE 100 * (close - b) / nullif(t - b, 0) END"}, ({"t": full("high", 14, f"max(high) {win(14)}"), "b": full("low", 14, f"min(low) {win(14)}")},))
study("ta_wpr", lambda s: {"wpr": s.wpr(14)}, {"wpr": "CASE WHEN t = b THEN 0 ELSE 100 * (close - t) / nullif(t - b, 0) END"}, ({"t": full("high", 14, f"max(high) {win(14)}"), "b": full("low", 14, f"min(low) {win(14)}")},))
study("ta_median", lambda s: {"odd": s.median("close", 9), "even": s.median("close", 10)}, {"odd": full("close", 9, f"median(close) {win(9)}"), "even": full("close", 10, f"median(close) {win(10)}")})
study("ta_mode", lambda s: {"mode_": s.mode("volume", 7)}, {"mode_": "list_min([x for x in w if len([y for y in w if y = x]) = list_max([len([y for y in w if y = z]) for z in w])])"}, ({"w": arr("volume", 7)},))
study("ta_percentile_nearest_rank", lambda s: {"p": s.percentile_nearest_rank("close", 10, 75)}, {"p": full("close", 10, f"quantile_disc(close, 0.75) {win(10)}")})
study("ta_percentile_linear_interpolation", lambda s: {"p": s.percentile_linear_interpolation("close", 10, 30)}, {"p": full("close", 10, f"quantile_cont(close, 0.3) {win(10)}")})
study("ta_percentrank", lambda s: {"percentrank": s.percentrank("close", 10)}, {"percentrank": "(len([x for x in w if x <= close]) - 1) * 10"}, ({"w": arr("close", 11)},))
study("ta_cog", lambda s: {"cog": s.cog("close", 8)}, {"cog": "-list_sum([x * (9 - i) for x, i in w]) / nullif(list_sum(w), 0)"}, ({"w": arr("close", 8)},))
study("ta_rci", lambda s: {"rci": s.rci("close", 8)}, {"rci": "100 * (1 - 6 * list_sum([power(9 - i - (1 + len([y for y in w if y > x])), 2) for x, i in w]) / 504)"}, ({"w": arr("close", 8)},))
study("ta_pivot", lambda s: {"pivothigh": s.pivothigh("high", 3, 2), "pivotlow": s.pivotlow("low", 3, 2)}, {"pivothigh": f"CASE WHEN bar_index >= 5 AND max(high) {win(6)} = {lag('high', 2)} THEN {lag('high', 2)} END", "pivotlow": f"CASE WHEN bar_index >= 5 AND min(low) {win(6)} = {lag('low', 2)} THEN {lag('low', 2)} END"})
study(
    "ta_cross",
    lambda s: {"over": s.crossover(s.hold(s.sma("close", 3)), s.hold(s.sma("close", 8))), "under": s.crossunder(s.hold(s.sma("close", 3)), s.hold(s.sma("close", 8))), "either": s.cross(s.hold(s.sma("close", 3)), s.hold(s.sma("close", 8)))},
    {"over": "o", "under": "u", "either": "o OR u"},
    ({"a": full("close", 3, f"avg(close) {win(3)}"), "b": full("close", 8, f"avg(close) {win(8)}")}, {"o": f"coalesce({lag('a')} <= {lag('b')} AND a > b, FALSE)", "u": f"coalesce({lag('a')} >= {lag('b')} AND a < b, FALSE)"}),
    ("over:bool", "under:bool", "either:bool"),
)
study("ta_rising_falling", lambda s: {"rising": s.rising("close", 3), "falling": s.falling("close", 3)}, {"rising": f"bar_index - max(br) {win()} >= 3", "falling": f"bar_index - max(bf) {win()} >= 3"}, ({"br": f"CASE WHEN coalesce(close > {lag('close')}, FALSE) THEN NULL ELSE bar_index END", "bf": f"CASE WHEN coalesce(close < {lag('close')}, FALSE) THEN NULL ELSE bar_index END"},), ("rising:bool", "falling:bool"))
study("ta_tr", lambda s: {"tr": s.tr(), "tr_na": s.tr(False)}, {"tr": "coalesce(t, high - low)", "tr_na": "t"}, ({"t": f"CASE WHEN bar_index > 0 THEN greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) END"},))
study("math_sum", lambda s: {"total": s.sum("close", 6)}, {"total": f"sum(close) {win(6)}"})
study("ta_wvad_iii", lambda s: {"wvad": s.wvad(), "iii": s.iii()}, {"wvad": "CASE WHEN high = low THEN 0 ELSE (close - open) / (high - low) * volume END", "iii": "CASE WHEN (high - low) * volume = 0 THEN 0 ELSE (2 * close - high - low) / ((high - low) * volume) END"})
study("history", lambda s: {"back": s.lag("close", 3), "index_back": F.when(F.col("bar_index") >= 2, F.col("bar_index") - 2)}, {"back": lag("close", 3), "index_back": "CASE WHEN bar_index >= 2 THEN bar_index - 2 END"}, (), ("index_back:long",))

# -- cumulative -------------------------------------------------------------------------------

study("ta_cum_max_min", lambda s: {"cum": s.cum("close"), "top": s.max("high"), "bottom": s.min("low")}, {"cum": f"sum(close) {win()}", "top": f"max(high) {win()}", "bottom": f"min(low) {win()}"})
study("ta_barssince", lambda s: {"since": s.barssince(F.col("close") > F.col("open"))}, {"since": f"bar_index - max(CASE WHEN close > open THEN bar_index END) {win()}"}, (), ("since:long",))
study("ta_valuewhen", lambda s: {"latest": s.valuewhen(F.col("close") > F.col("open"), "close", 0), "before": s.valuewhen(F.col("close") > F.col("open"), "close", 2)}, {"latest": "ups[-1]", "before": "ups[-3]"}, ({"ups": f"list(close) FILTER (WHERE close > open) {win()}"},))
study("ta_obv", lambda s: {"obv": s.obv()}, {"obv": f"sum(d) {win()}"}, ({"d": f"coalesce(volume * sign(close - {lag('close')}), 0)"},))
study("ta_accdist", lambda s: {"accdist": s.accdist()}, {"accdist": f"sum(CASE WHEN high = low THEN 0 ELSE ((close - low) - (high - close)) / (high - low) * volume END) {win()}"})
study("ta_pvt", lambda s: {"pvt": s.pvt()}, {"pvt": f"sum(d) {win()}"}, ({"d": f"coalesce((close - {lag('close')}) / nullif({lag('close')}, 0) * volume, 0)"},))
study("ta_wad", lambda s: {"wad": s.wad()}, {"wad": f"sum(d) {win()}"}, ({"p": lag("close")}, {"d": "CASE WHEN close > p THEN close - least(low, p) WHEN close < p THEN close - greatest(high, p) ELSE 0 END"}))
study("ta_fixnan", lambda s: {"held": s.fixnan(F.when(F.col("volume") > 2, F.col("close")))}, {"held": f"last_value(x IGNORE NULLS) {win()}"}, ({"x": "CASE WHEN volume > 2 THEN close END"},))
study(
    "ta_vwap",
    lambda s: dict(zip(("vwap", "up", "low_"), s.vwap("close", F.col("bar_index") % 24 == 0, 1.5), strict=True)) | {"whole": s.vwap("close")},
    {"vwap": "m", "up": "m + 1.5 * sqrt(greatest(0, q / v - m * m))", "low_": "m - 1.5 * sqrt(greatest(0, q / v - m * m))", "whole": f"sum(close * volume) {win()} / nullif(sum(volume) {win()}, 0)"},
    ({"g": "bar_index // 24"}, {"v": "sum(volume) OVER gw", "m": "sum(close * volume) OVER gw / nullif(sum(volume) OVER gw, 0)", "q": "sum(close * close * volume) OVER gw"}),
)
ORACLE_SQL["ta_vwap"] = ORACLE_SQL["ta_vwap"].replace("OVER gw", "OVER (PARTITION BY symbol, g ORDER BY bar_index ROWS UNBOUNDED PRECEDING)")

LEVELS = ("p", "r1", "s1", "r2", "s2", "r3", "s3", "r4", "s4", "r5", "s5")


def ta_pivot_point_levels(spark, sf_dir):
    s = Study(hourly(spark, sf_dir))
    own = {"Traditional": s.pivot_point_levels("Traditional", F.col("bar_index") % 24 == 0)}
    out = s.result(levels=own["Traditional"])
    return out.select("symbol", F.col("bar_index").cast("long").alias("bar_index"), *[r6(F.get("levels", F.lit(i))).alias(c) for i, c in enumerate(LEVELS)])


_register(
    "ta_pivot_point_levels",
    ta_pivot_point_levels,
    f"""WITH {BARS}, g AS (SELECT *, bar_index // 24 AS g FROM bars), k AS (SELECT symbol, g + 1 AS g, max(high) AS h, min(low) AS l, arg_max(close, bar_index) AS c FROM g GROUP BY 1, 2),
    j AS (SELECT g.symbol, bar_index, h, l, (h + l + c) / 3 AS p FROM g LEFT JOIN k USING (symbol, g))
    SELECT symbol, bar_index::BIGINT AS bar_index, round(p, 6) + 0.0 AS p, round(2 * p - l, 6) + 0.0 AS r1, round(2 * p - h, 6) + 0.0 AS s1, round(p + h - l, 6) + 0.0 AS r2, round(p - h + l, 6) + 0.0 AS s2,
    round(2 * p + h - 2 * l, 6) + 0.0 AS r3, round(2 * p - 2 * h + l, 6) + 0.0 AS s3, round(3 * p + h - 3 * l, 6) + 0.0 AS r4, round(3 * p - 3 * h + l, 6) + 0.0 AS s4, round(4 * p + h - 4 * l, 6) + 0.0 AS r5, round(4 * p - 4 * h + l, 6) + 0.0 AS s5 FROM j""",
)

# -- recursive ----------------------------------------------------------------------------------


def scanned(name: str, ops: list[tuple], sql: str | None = None) -> None:
    made = [n for o in ops for n in o[3]]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return scan.scan(hourly(spark, sf_dir), *ops).select("symbol", F.col("bar_index").cast("long").alias("bar_index"), *[r6(F.col(c)).alias(c) for c in made])

    _register(name, query, sql)


def smooth(name: str, src: str, values: dict[str, tuple[str, int, float]]) -> str:
    """CTEs that end in ``name``: src with exponential smoothings, column -> (series, length, weight), seeded by the mean of the first values."""
    counts = ", ".join(f"CASE WHEN {x} IS NOT NULL THEN count({x}) {win()} END AS k_{c}" for c, (x, _, _) in values.items())
    seeds = ", ".join(f"CASE WHEN k_{c} = {n} THEN (SELECT avg(z.{x}) FROM {name}_b z WHERE z.symbol = b.symbol AND z.k_{c} <= {n}) END AS f_{c}" for c, (x, n, _) in values.items())
    start = ", ".join(f"f_{c} AS {c}" for c in values)
    step = ", ".join(f"CASE WHEN s.k_{c} = {n} THEN s.f_{c} WHEN s.k_{c} > {n} THEN {a!r} * s.{x} + (1 - {a!r}) * r.{c} ELSE r.{c} END" for c, (x, n, a) in values.items())
    shown = ", ".join(f"CASE WHEN s.k_{c} >= {n} THEN r.{c} END AS {c}" for c, (_, n, _) in values.items())
    return f"""{name}_b AS (SELECT *, {counts} FROM {src}), {name}_s AS (SELECT b.*, {seeds} FROM {name}_b b),
    {name}_r AS (SELECT symbol, bar_index, {start} FROM {name}_s WHERE bar_index = 0 UNION ALL SELECT s.symbol, s.bar_index, {step} FROM {name}_r r JOIN {name}_s s ON s.symbol = r.symbol AND s.bar_index = r.bar_index + 1),
    {name} AS (SELECT s.*, {shown} FROM {name}_s s JOIN {name}_r r ON s.symbol = r.symbol AND s.bar_index = r.bar_index)"""


def recursive(ctes: list[str], src: str, **shown: str) -> str:
    return f"WITH RECURSIVE {BARS}, " + ", ".join(ctes) + " SELECT symbol, bar_index::BIGINT AS bar_index, " + ", ".join(f"round({v}, 6) + 0.0 AS {k}" for k, v in shown.items()) + f" FROM {src}"


ema_ = lambda x, n: (x, n, 2 / (n + 1))
rma_ = lambda x, n: (x, n, 1 / n)
MOVES = f"moves AS (SELECT *, close - {lag('close')} AS d, abs(close - {lag('close')}) AS da, greatest(coalesce(close - {lag('close')}, 0), 0) AS up, greatest(coalesce({lag('close')} - close, 0), 0) AS down, CASE WHEN bar_index = 0 THEN high - low ELSE greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) END AS tr, high - {lag('high')} AS rise, {lag('low')} - low AS drop_ FROM bars)"
scanned("ta_ema", [scan.op("ema", 9)], recursive([smooth("a", "bars", {"ema": ema_("close", 9)})], "a", ema="ema"))
scanned("ta_rma", [scan.op("rma", 7)], recursive([smooth("a", "bars", {"rma": rma_("close", 7)})], "a", rma="rma"))
scanned("ta_dema", [scan.op("dema", 6)], recursive([smooth("a", "bars", {"e1": ema_("close", 6)}), smooth("b", "a", {"e2": ema_("e1", 6)})], "b", dema="2 * e1 - e2"))
scanned("ta_rsi", [scan.op("rsi", 14)], recursive([MOVES, smooth("a", "moves", {"u": rma_("up", 14), "v": rma_("down", 14)})], "a", rsi="CASE WHEN v = 0 THEN 100 ELSE 100 - 100 / (1 + u / v) END"))
scanned("ta_atr", [scan.op("atr", 14)], recursive([MOVES, smooth("a", "moves", {"atr": rma_("tr", 14)})], "a", atr="atr"))
scanned("ta_macd", [scan.op("macd", 12, 26, 9, to=("macd", "signal", "hist"))], recursive([smooth("a", "bars", {"fast": ema_("close", 12), "slow": ema_("close", 26)}), "m AS (SELECT *, fast - slow AS macd FROM a)", smooth("b", "m", {"sig": ema_("macd", 9)})], "b", macd="macd", signal="sig", hist="macd - sig"))
scanned("ta_tsi", [scan.op("tsi", 5, 13)], recursive([MOVES, smooth("a", "moves", {"p1": ema_("d", 13), "a1": ema_("da", 13)}), smooth("b", "a", {"p2": ema_("p1", 5), "a2": ema_("a1", 5)})], "b", tsi="CASE WHEN a2 = 0 THEN 0 ELSE p2 / a2 END"))
scanned("ta_kc", [scan.op("kc", 10, 1.5, to=("mid", "up", "low_")), scan.op("kcw", 10, 1.5)], recursive([MOVES, smooth("a", "moves", {"m": ema_("close", 10), "r": rma_("tr", 10)})], "a", mid="m", up="m + 1.5 * r", low_="m - 1.5 * r", kcw="3 * r / nullif(m, 0) * 100"))
scanned(
    "ta_supertrend",
    [scan.op("supertrend", 3.0, 10, to=("line", "direction"))],
    recursive(
        [
            MOVES,
            smooth("a", "moves", {"r": rma_("tr", 10)}),
            "b AS (SELECT *, (high + low) / 2 + 3 * r AS bu, (high + low) / 2 - 3 * r AS bd FROM a)",
            """st AS (SELECT symbol, bar_index, bu AS u, bd AS d_, CASE WHEN close < bd THEN -1 ELSE 1 END AS way, close AS c FROM b WHERE bar_index = 9
            UNION ALL SELECT b.symbol, b.bar_index, CASE WHEN bu < u OR c > u THEN bu ELSE u END, CASE WHEN bd > d_ OR c < d_ THEN bd ELSE d_ END, CASE WHEN way = -1 AND close > u THEN 1 WHEN way = 1 AND close < d_ THEN -1 ELSE way END, close FROM st JOIN b ON b.symbol = st.symbol AND b.bar_index = st.bar_index + 1)""",
            "z AS (SELECT bars.symbol, bars.bar_index, u, d_, way FROM bars LEFT JOIN st ON bars.symbol = st.symbol AND bars.bar_index = st.bar_index)",
        ],
        "z",
        line="CASE WHEN way = 1 THEN d_ ELSE u END",
        direction="coalesce(way, 0)",
    ),
)
scanned(
    "ta_sar",
    [scan.op("sar", 0.02, 0.02, 0.2)],
    recursive(
        [
            f"b AS (SELECT *, {lag('high')} AS h1, {lag('low')} AS l1, {lag('high', 2)} AS h2, {lag('low', 2)} AS l2, {lag('close')} AS c1 FROM bars)",
            """p AS (SELECT symbol, bar_index, NULL::DOUBLE AS stop, NULL::DOUBLE AS best, NULL::DOUBLE AS rate, FALSE AS up FROM b WHERE bar_index = 0 UNION ALL
            SELECT symbol, bar_index, CASE WHEN up3 THEN least(stop3, l1, coalesce(l2, l1)) ELSE greatest(stop3, h1, coalesce(h2, h1)) END, CASE WHEN fresh3 THEN best3 WHEN up3 THEN greatest(best3, high) ELSE least(best3, low) END, CASE WHEN NOT fresh3 AND (CASE WHEN up3 THEN high > best3 ELSE low < best3 END) THEN least(rate3 + 0.02, 0.2) ELSE rate3 END, up3 FROM (
              SELECT *, turn OR first_ AS fresh3, up2 <> turn AS up3, CASE WHEN turn THEN (CASE WHEN up2 THEN greatest(high, best2) ELSE least(low, best2) END) ELSE stop2 END AS stop3, CASE WHEN turn THEN (CASE WHEN up2 THEN low ELSE high END) ELSE best2 END AS best3, CASE WHEN turn THEN 0.02 ELSE rate2 END AS rate3 FROM (
                SELECT *, CASE WHEN up2 THEN stop2 > low ELSE stop2 < high END AS turn FROM (
                  SELECT *, stop1 + rate2 * (best2 - stop1) AS stop2 FROM (
                    SELECT b.symbol, b.bar_index, high, low, h1, l1, h2, l2, stop IS NULL AS first_, CASE WHEN stop IS NULL THEN close > c1 ELSE up END AS up2, coalesce(rate, 0.02) AS rate2, CASE WHEN stop IS NULL THEN (CASE WHEN close > c1 THEN high ELSE low END) ELSE best END AS best2, CASE WHEN stop IS NULL THEN (CASE WHEN close > c1 THEN l1 ELSE h1 END) ELSE stop END AS stop1
                    FROM p JOIN b ON b.symbol = p.symbol AND b.bar_index = p.bar_index + 1)))))""",
        ],
        "p",
        sar="stop",
    ),
)
scanned(
    "ta_dmi",
    [scan.op("dmi", 14, 14, to=("plus", "minus", "adx"))],
    recursive(
        [
            MOVES,
            "dm AS (SELECT *, CASE WHEN rise > drop_ AND rise > 0 THEN rise ELSE 0 END AS pd, CASE WHEN drop_ > rise AND drop_ > 0 THEN drop_ ELSE 0 END AS md FROM moves)",
            "q AS (SELECT symbol, bar_index, tr AS st, pd AS sp, md AS sm FROM dm WHERE bar_index = 14 UNION ALL SELECT dm.symbol, dm.bar_index, tr / 14 + 13 / 14.0::DOUBLE * st, pd / 14 + 13 / 14.0::DOUBLE * sp, md / 14 + 13 / 14.0::DOUBLE * sm FROM q JOIN dm ON dm.symbol = q.symbol AND dm.bar_index = q.bar_index + 1)",
            "di AS (SELECT bars.symbol, bars.bar_index, 100 * sp / nullif(st, 0) AS plus, 100 * sm / nullif(st, 0) AS minus FROM bars LEFT JOIN q ON bars.symbol = q.symbol AND bars.bar_index = q.bar_index AND q.bar_index > 14)",
            "dx AS (SELECT *, CASE WHEN plus + minus > 0 THEN abs(plus - minus) / (plus + minus) * 100 WHEN plus IS NOT NULL THEN 0 END AS dx FROM di)",
            smooth("a", "dx", {"adx": rma_("dx", 14)}),
        ],
        "a",
        plus="plus",
        minus="minus",
        adx="adx",
    ),
)
#: The 32-bit shifts of the generator, and the mixing of its first state from the place of use (1).
_MIXED = "SELECT xor(h, h >> 16) AS x FROM (SELECT (xor(h, h >> 13)::HUGEINT * 3266489909 % 4294967296)::BIGINT AS h FROM (SELECT (xor(h, h >> 16)::HUGEINT * 2246822507 % 4294967296)::BIGINT AS h FROM (SELECT xor(1::BIGINT, 2654435769::BIGINT) AS h)))"
scanned(
    "math_random",
    [scan.op("random", 0.0, 10.0)],
    f"""WITH RECURSIVE {BARS}, first_ AS ({_MIXED}), draws AS (SELECT -1::BIGINT AS i, x FROM first_ UNION ALL
    SELECT i + 1, xor(c, (c << 5) & 4294967295) FROM (SELECT i, xor(b, b >> 17) AS c FROM (SELECT i, xor(x, (x << 13) & 4294967295) AS b FROM draws WHERE i < (SELECT max(bar_index) FROM bars))))
    SELECT symbol, bar_index::BIGINT AS bar_index, round(x / 4294967296.0::DOUBLE * 10, 6) + 0.0 AS random FROM bars JOIN draws ON i = bar_index""",
)
_VOLUME_INDEX = f"""WITH RECURSIVE {BARS}, src AS (SELECT *, CASE WHEN {lag('close')} <> 0 THEN (close - {lag('close')}) / {lag('close')} ELSE 0 END AS c, volume - {lag('volume')} AS d FROM bars),
r AS (SELECT symbol, bar_index, 1::DOUBLE AS nvi, 1::DOUBLE AS pvi FROM src WHERE bar_index = 0 UNION ALL
SELECT s.symbol, s.bar_index, CASE WHEN d < 0 THEN nvi + c * nvi ELSE nvi END, CASE WHEN d > 0 THEN pvi + c * pvi ELSE pvi END FROM r JOIN src s ON s.symbol = r.symbol AND s.bar_index = r.bar_index + 1)
SELECT symbol, bar_index::BIGINT AS bar_index, nvi, pvi FROM r"""


def ta_nvi_pvi(spark, sf_dir):
    """Products of many returns span many magnitudes, so six significant digits are compared."""
    out = scan.scan(hourly(spark, sf_dir), scan.op("nvi"), scan.op("pvi"))
    return out.select("symbol", F.col("bar_index").cast("long").alias("bar_index"), *[F.format_string("%.6e", F.col(c)).alias(c) for c in ("nvi", "pvi")])


_register("ta_nvi_pvi", ta_nvi_pvi, _VOLUME_INDEX.replace("AS bar_index, nvi, pvi FROM r", "AS bar_index, printf('%.6e', nvi) AS nvi, printf('%.6e', pvi) AS pvi FROM r"))


def ta_variable_length(spark, sf_dir):
    rows = hourly(spark, sf_dir).withColumn("n", (F.col("bar_index") % 5 + 1).cast("double"))
    ops = [scan.op(k, "n", to=k) for k in ("highest", "lowest", "sma", "wma", "median", "stdev", "linreg", "highestbars", "lowestbars", "sum", "range")]
    return scan.scan(rows, *ops).select("symbol", F.col("bar_index").cast("long").alias("bar_index"), *[r6(F.col(o[3][0])).alias("v_" + o[3][0]) for o in ops])


_register(
    "ta_variable_length",
    ta_variable_length,
    f"""WITH {BARS}, a AS (SELECT *, bar_index % 5 + 1 AS n, list(close) {win(5)} AS l FROM bars), b AS (SELECT *, CASE WHEN n <= len(l) THEN l[len(l) - n + 1:] END AS w, l[greatest(1, len(l) - n + 1):] AS u FROM a)
    SELECT symbol, bar_index::BIGINT AS bar_index, round(list_max(w), 6) + 0.0 AS v_highest, round(list_min(w), 6) + 0.0 AS v_lowest, round(list_avg(w), 6) + 0.0 AS v_sma, round(list_sum([x * i for x, i in w]) / (n * (n + 1) / 2), 6) + 0.0 AS v_wma, round(list_median(w), 6) + 0.0 AS v_median,
    round(sqrt(list_avg([power(x - list_avg(w), 2) for x in w])), 6) + 0.0 AS v_stdev, round(CASE WHEN n = 1 THEN w[1] ELSE list_avg(w) + list_sum([(i - (n + 1) / 2.0) * x for x, i in w]) / (n * (n * n - 1) / 12.0) * (n - 1) / 2 END, 6) + 0.0 AS v_linreg,
    round(list_max([i - n for x, i in w if x = list_max(w)]), 6) + 0.0 AS v_highestbars, round(list_max([i - n for x, i in w if x = list_min(w)]), 6) + 0.0 AS v_lowestbars, round(list_sum(u), 6) + 0.0 AS v_sum, round(list_max(w) - list_min(w), 6) + 0.0 AS v_range FROM b""",
)

# -- higher timeframes ---------------------------------------------------------------------------

_DAYS = f"""WITH {BARS}, d AS (SELECT *, dense_rank() OVER (PARTITION BY symbol ORDER BY date_trunc('day', time)) - 1 AS h FROM bars),
g AS (SELECT symbol, h, arg_min(open, bar_index) AS open, max(high) AS high, min(low) AS low, arg_max(close, bar_index) AS close, sum(volume) AS volume, min(time_ms) AS time_ms FROM d GROUP BY 1, 2)"""


def htf_bars(spark, sf_dir):
    return htf.higher(hourly(spark, sf_dir), "D", timed=True).select("symbol", F.col("bar_index").cast("long").alias("bar_index"), "time_ms", "open", "high", "low", "close", "volume", "time_close")


_register("htf_bars", htf_bars, _DAYS + " SELECT symbol, h::BIGINT AS bar_index, time_ms, open, high, low, close, volume, coalesce(lead(time_ms) OVER w, 2 * time_ms - lag(time_ms) OVER w, time_ms)::BIGINT AS time_close FROM g WINDOW w AS (PARTITION BY symbol ORDER BY h)")


def security_query(name: str, lookahead: bool, gaps: bool) -> None:
    def query(spark, sf_dir):
        out = htf.security(hourly(spark, sf_dir), "D", {"d_close": "close", "d_volume": "volume", "d_sma": lambda s: s.sma("close", 3), "d_back": lambda s: s.lag("high", 1)}, lookahead, gaps, timed=True)
        return out.select("symbol", F.col("bar_index").cast("long").alias("bar_index"), *[r6(F.col(c)).alias(c) for c in ("d_close", "d_volume", "d_sma", "d_back")])

    shown = [("d_close", "k.close"), ("d_volume", "k.volume"), ("d_sma", "k.sma"), ("d_back", "k.back")]
    gate = (lambda v: f"CASE WHEN coalesce(d.before <> d.h, TRUE) THEN {v} END") if gaps else (lambda v: v)
    sql = _DAYS + f", k AS (SELECT *, CASE WHEN h >= 2 THEN avg(close) OVER (w ROWS 2 PRECEDING) END AS sma, lag(high) OVER w AS back FROM g WINDOW w AS (PARTITION BY symbol ORDER BY h)), e AS (SELECT *, lag(h) {LINE} AS before FROM d) SELECT d.symbol, d.bar_index::BIGINT AS bar_index, " + ", ".join(f"round({gate(v)}, 6) + 0.0 AS {c}" for c, v in shown) + f" FROM e d LEFT JOIN k ON k.symbol = d.symbol AND k.h = d.h - {0 if lookahead else 1}"
    _register(name, query, sql)


security_query("security_daily", False, False)
security_query("security_daily_lookahead", True, False)
security_query("security_daily_gaps", False, True)
ORACLE_SQL = {k: v.replace("avg(close) OVER (w ROWS 2 PRECEDING)", "avg(close) OVER (PARTITION BY symbol ORDER BY h ROWS 2 PRECEDING)") for k, v in ORACLE_SQL.items()}

# -- scalars ----------------------------------------------------------------------------------------


def scalars(name: str, source: str, build: Callable[[], dict[str, Column]], keys: str, sql: str, doubles: tuple[str, ...] = ()) -> None:
    def query(spark, sf_dir):
        made = build()
        return table(spark, sf_dir, source).select(*keys.split(", "), *[(r6(v) if k in doubles else v).alias(k) for k, v in made.items()])

    _register(name, query, sql)


scalars(
    "math_scalars",
    "lineitem",
    lambda: {
        "m_max": C.maximum("l_discount", "l_tax"), "m_min": C.minimum("l_discount", "l_tax"), "m_avg": C.average("l_discount", F.nullif("l_tax", F.lit(0.0))), "m_round": C.rounded(F.col("l_extendedprice") / 7, 2), "m_tick": C.to_tick(F.col("l_extendedprice") / 3, 0.05), "m_floor": F.floor(F.col("l_extendedprice")).cast("long"), "m_ceil": F.ceil(F.col("l_extendedprice")).cast("long"), "m_sign": F.signum(F.col("l_discount") - F.col("l_tax")).cast("long"),
        "m_log": C.log(F.col("l_discount") - 0.03), "m_log10": C.log10(F.col("l_tax")), "m_sqrt": C.sqrt(F.col("l_discount") - 0.05), "m_pow": C.power("l_quantity", 1.5), "m_exp": F.exp("l_tax"), "m_clamp": C.clamp("l_quantity", 10.0, 30.0), "m_abs": F.abs(F.col("l_discount") - F.col("l_tax")), "m_div": C.divide("l_discount", "l_tax"), "m_intdiv": C.int_divide(F.col("l_linenumber") - 4, F.lit(2)), "m_mod": C.remainder(F.col("l_linenumber") - 4, 3).cast("long"),
        "m_sin": F.sin("l_quantity"), "m_cos": F.cos("l_quantity"), "m_tan": F.tan("l_tax"), "m_asin": C.asin(F.col("l_quantity") / 40), "m_acos": C.acos(F.col("l_quantity") / 40), "m_atan": F.atan("l_quantity"), "m_atan2": F.atan2("l_discount", "l_tax"), "m_deg": C.todegrees("l_tax"), "m_rad": C.toradians("l_quantity"),
        "m_nz": C.nz(F.nullif("l_tax", F.lit(0.0)), -1.0), "m_na": C.na(F.nullif("l_tax", F.lit(0.0))), "m_eq": C.equal(F.nullif("l_tax", F.lit(0.0)), F.col("l_discount")), "m_if": C.choose(F.nullif("l_tax", F.lit(0.0)) > 0.04, "l_discount", "l_tax"),
    },
    "l_orderkey, l_linenumber",
    """SELECT l_orderkey, l_linenumber, round(greatest(l_discount, l_tax), 6) + 0.0 AS m_max, round(least(l_discount, l_tax), 6) + 0.0 AS m_min, round(CASE WHEN l_tax = 0 THEN l_discount ELSE (l_discount + l_tax) / 2 END, 6) + 0.0 AS m_avg, round(floor(l_extendedprice / 7 * 100.0 + 0.5) / 100.0, 6) + 0.0 AS m_round, round(floor(l_extendedprice / 3 / 0.05 + 0.5) * 0.05, 6) + 0.0 AS m_tick, floor(l_extendedprice)::BIGINT AS m_floor, ceil(l_extendedprice)::BIGINT AS m_ceil, sign(l_discount - l_tax)::BIGINT AS m_sign,
    round(CASE WHEN l_discount - 0.03 > 0 THEN ln(l_discount - 0.03) END, 6) + 0.0 AS m_log, round(CASE WHEN l_tax > 0 THEN log10(l_tax) END, 6) + 0.0 AS m_log10, round(CASE WHEN l_discount - 0.05 >= 0 THEN sqrt(l_discount - 0.05) END, 6) + 0.0 AS m_sqrt, round(power(l_quantity, 1.5), 6) + 0.0 AS m_pow, round(exp(l_tax), 6) + 0.0 AS m_exp, round(least(greatest(l_quantity, 10), 30), 6) + 0.0 AS m_clamp, round(abs(l_discount - l_tax), 6) + 0.0 AS m_abs, round(l_discount / nullif(l_tax, 0), 6) + 0.0 AS m_div, trunc((l_linenumber - 4) / 2.0)::BIGINT AS m_intdiv, ((l_linenumber - 4) % 3)::BIGINT AS m_mod,
    round(sin(l_quantity), 6) + 0.0 AS m_sin, round(cos(l_quantity), 6) + 0.0 AS m_cos, round(tan(l_tax), 6) + 0.0 AS m_tan, round(CASE WHEN l_quantity <= 40 THEN asin(least(1, l_quantity / 40)) END, 6) + 0.0 AS m_asin, round(CASE WHEN l_quantity <= 40 THEN acos(least(1, l_quantity / 40)) END, 6) + 0.0 AS m_acos, round(atan(l_quantity), 6) + 0.0 AS m_atan, round(atan2(l_discount, l_tax), 6) + 0.0 AS m_atan2, round(l_tax * 180 / pi(), 6) + 0.0 AS m_deg, round(l_quantity * pi() / 180, 6) + 0.0 AS m_rad,
    round(CASE WHEN l_tax = 0 THEN -1 ELSE l_tax END, 6) + 0.0 AS m_nz, l_tax = 0 AS m_na, l_tax <> 0 AND l_tax = l_discount AS m_eq, round(CASE WHEN l_tax > 0.04 THEN l_discount ELSE l_tax END, 6) + 0.0 AS m_if FROM lineitem""",
    ("m_max", "m_min", "m_avg", "m_round", "m_tick", "m_log", "m_log10", "m_sqrt", "m_pow", "m_exp", "m_clamp", "m_abs", "m_div", "m_sin", "m_cos", "m_tan", "m_asin", "m_acos", "m_atan", "m_atan2", "m_deg", "m_rad", "m_nz", "m_if"),
)
scalars(
    "str_scalars",
    "part",
    lambda: {
        "s_len": C.length("p_name").cast("long"), "s_has": F.contains(F.col("p_name"), F.lit("a")), "s_starts": F.startswith(F.col("p_type"), F.lit("S")), "s_ends": F.endswith(F.col("p_type"), F.lit("L")), "s_pos": C.pos("p_name", "a").cast("long"), "s_lower": F.lower("p_type"), "s_upper": F.upper("p_name"), "s_trim": C.trim(F.concat(F.lit("  "), "p_brand", F.lit(" \t"))), "s_all": F.replace(F.col("p_name"), F.lit("a"), F.lit("<>")), "s_nth": C.replace_nth("p_name", "a", "#", 2),
        "s_sub": C.substring("p_name", 2, 5), "s_sub_end": C.substring("p_name", 3), "s_repeat": C.repeat("p_brand", 2, "-"), "s_split": F.size(C.split("p_name", " ")).cast("long"), "s_match": C.match("p_brand", "[0-9]+"), "s_num": C.tonumber(F.substring("p_brand", 7, 9)), "s_plus": F.concat("p_brand", F.lit("/"), "p_type"),
    },
    "p_partkey",
    """SELECT p_partkey, length(p_name)::BIGINT AS s_len, contains(p_name, 'a') AS s_has, starts_with(p_type, 'S') AS s_starts, ends_with(p_type, 'L') AS s_ends, (strpos(p_name, 'a') - 1)::BIGINT AS s_pos, lower(p_type) AS s_lower, upper(p_name) AS s_upper, p_brand AS s_trim, replace(p_name, 'a', '<>') AS s_all,
    CASE WHEN len(string_split(p_name, 'a')) > 2 THEN array_to_string(string_split(p_name, 'a')[1:2], 'a') || '#' || array_to_string(string_split(p_name, 'a')[3:], 'a') ELSE p_name END AS s_nth,
    p_name[3:5] AS s_sub, p_name[4:] AS s_sub_end, p_brand || '-' || p_brand AS s_repeat, len(string_split(p_name, ' '))::BIGINT AS s_split, regexp_extract(p_brand, '[0-9]+') AS s_match, TRY_CAST(substr(p_brand, 7, 9) AS DOUBLE) AS s_num, p_brand || '/' || p_type AS s_plus FROM part""",
)
scalars(
    "str_tostring",
    "part",
    lambda: {"t_plain": C.tostring("p_retailprice"), "t_percent": C.tostring("p_retailprice", "percent"), "t_two": C.tostring("p_retailprice", "#.##"), "t_whole": C.tostring("p_retailprice", "integer"), "t_volume": C.tostring(F.col("p_retailprice") * 1000, "volume"), "t_number": C.format_number("p_retailprice", "0.00"), "t_time": C.format_time(F.col("p_partkey").cast("long") * 133_200_000, "yyyy-MM-dd HH:mm:ss"), "t_text": C.format_text("{0}: {1,number,#.##}", F.col("p_brand"), F.col("p_retailprice"))},
    "p_partkey",
    """WITH p AS (SELECT *, printf('%.2f', p_retailprice) AS two, p_retailprice * 1000 AS v FROM part)
    SELECT p_partkey, p_retailprice::DOUBLE::VARCHAR AS t_plain, two || '%' AS t_percent, two AS t_two, trunc(p_retailprice)::BIGINT::VARCHAR AS t_whole, CASE WHEN v >= 1000000 THEN printf('%.2f', v / 1000000) || 'M' ELSE printf('%.2f', v / 1000) || 'K' END AS t_volume, two AS t_number, strftime(make_timestamp(p_partkey * 133200000000), '%Y-%m-%d %H:%M:%S') AS t_time, p_brand || ': ' || two AS t_text FROM p""",
)
scalars(
    "time_scalars",
    "orders",
    lambda: {k: v.cast("long") for k, v in (lambda ms: {"t_year": C.year(ms), "t_month": C.month(ms), "t_day": C.dayofmonth(ms), "t_dow": C.dayofweek(ms), "t_week": C.weekofyear(ms), "t_hour": C.hour(ms), "t_hour_east": C.hour(ms, "UTC+05:30"), "t_day_start": C.period_start(ms, "D"), "t_week_start": C.period_start(ms, "W"), "t_month_start": C.period_start(ms, "M"), "t_month_end": C.period_end(ms, "M"), "t_4h": C.period_start(ms, "240"), "t_made": C.timestamp(C.year(ms), C.month(ms) + 14, 1, 5, 30), "t_open": C.in_session(ms, "0900-1700:23456").cast("int")})(F.unix_millis(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") * 3_600_000).items()},
    "o_orderkey",
    """WITH t AS (SELECT o_orderkey, o_orderdate + to_hours(o_orderkey) AS t FROM orders)
    SELECT o_orderkey, year(t) AS t_year, month(t) AS t_month, day(t) AS t_day, dayofweek(t) + 1 AS t_dow, weekofyear(t) AS t_week, hour(t) AS t_hour, hour(t + INTERVAL 330 MINUTE) AS t_hour_east, epoch_ms(date_trunc('day', t)::TIMESTAMP) AS t_day_start, epoch_ms(date_trunc('week', t)::TIMESTAMP) AS t_week_start, epoch_ms(date_trunc('month', t)::TIMESTAMP) AS t_month_start, epoch_ms((date_trunc('month', t) + INTERVAL 1 MONTH)::TIMESTAMP) AS t_month_end, epoch_ms(t) // 14400000 * 14400000 AS t_4h,
    epoch_ms((date_trunc('month', t) + INTERVAL 14 MONTH + INTERVAL 330 MINUTE)::TIMESTAMP) AS t_made, CASE WHEN hour(t) BETWEEN 9 AND 16 AND dayofweek(t) BETWEEN 1 AND 5 THEN 1 ELSE 0 END AS t_open FROM t""",
)
scalars(
    "array_scalars",
    "embeddings",
    lambda: {k: v for k, v in (lambda a: {"a_size": F.size(a).cast("long"), "a_get": C.get(a, F.lit(2)), "a_out": C.get(a, F.lit(100_000)), "a_sum": C.array_sum(a), "a_avg": C.array_avg(a), "a_max": C.array_nth(a, 1), "a_min": C.array_nth(a, 0, False), "a_range": C.array_range(a), "a_median": C.array_median(a), "a_variance": C.array_variance(a), "a_stdev": C.array_stdev(a), "a_cov": C.array_covariance(a, F.reverse(a)), "a_z": C.get(C.array_standardize(a), F.lit(0)), "a_rank": C.array_percentile_nearest_rank(a, 40), "a_lin": C.array_percentile_linear(a, 40), "a_pr": C.array_percentrank(a, F.lit(0.0)), "a_has": F.array_contains(a, F.get(a, F.lit(3))), "a_at": C.index_of(a, F.get(a, F.lit(3))).cast("long"), "a_first_sorted": C.get(C.array_sort(a), F.lit(0)), "a_order": C.get(C.sort_indices(a), F.lit(0)).cast("long"), "a_slice": F.size(C.array_slice(a, 2, 5)).cast("long"), "a_search": C.binary_search(F.array_sort(a), F.get(a, F.lit(3))).cast("long"), "a_every": C.every(a), "a_join": F.array_join(F.transform(C.array_slice(a, 0, 3), lambda v: F.floor(v * 100).cast("string")), ",")})(F.col("embedding").cast("array<double>")).items()},
    "vec_id",
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS a FROM embeddings), s AS (SELECT *, list_sort(a) AS s, len(a) AS n, list_avg(a) AS m, list_var_pop(a) AS v FROM e)
    SELECT vec_id, n::BIGINT AS a_size, round(a[3], 6) + 0.0 AS a_get, NULL::DOUBLE AS a_out, round(list_sum(a), 6) + 0.0 AS a_sum, round(m, 6) + 0.0 AS a_avg, round(s[-2], 6) + 0.0 AS a_max, round(s[1], 6) + 0.0 AS a_min, round(s[-1] - s[1], 6) + 0.0 AS a_range, round(list_median(a), 6) + 0.0 AS a_median, round(v, 6) + 0.0 AS a_variance, round(sqrt(v), 6) + 0.0 AS a_stdev,
    round(list_avg([(x - m) * (a[n + 1 - i] - m) for x, i in a]), 6) + 0.0 AS a_cov, round((a[1] - m) / sqrt(v), 6) + 0.0 AS a_z, round(s[ceil(0.4 * n)::INT], 6) + 0.0 AS a_rank, round(list_aggregate(a, 'quantile_cont', 0.4), 6) + 0.0 AS a_lin, round(100.0 * len([x for x in a if x < 0]) / n, 6) + 0.0 AS a_pr, TRUE AS a_has, (list_position(a, a[4]) - 1)::BIGINT AS a_at, round(s[1], 6) + 0.0 AS a_first_sorted, (list_position(a, s[1]) - 1)::BIGINT AS a_order, 3::BIGINT AS a_slice, (list_position(s, a[4]) - 1)::BIGINT AS a_search, len([x for x in a if x = 0]) = 0 AS a_every, floor(a[1] * 100)::BIGINT || ',' || floor(a[2] * 100)::BIGINT || ',' || floor(a[3] * 100)::BIGINT AS a_join FROM s""",
    ("a_get", "a_out", "a_sum", "a_avg", "a_max", "a_min", "a_range", "a_median", "a_variance", "a_stdev", "a_cov", "a_z", "a_rank", "a_lin", "a_pr", "a_first_sorted"),
)
def matrix_scalars(spark, sf_dir):
    cell = lambda i: F.get(F.col("embedding"), F.lit(i)).cast("double")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.array(F.array(cell(0), cell(1)), F.array(cell(2), cell(3))).alias("m"))
    rows = rows.withColumn("mt", C.mult("m", C.transpose("m")))
    at = lambda x, i, j: r6(F.get(F.get(x, F.lit(i)), F.lit(j)))
    found = rows.select("vec_id", "m", "mt", C.det("m").alias("d"), C.rank("m").alias("m_rank"), C.inverse("m").alias("inv"), C.matrix_power("m", 3).alias("cube"), C.eigenvalues("mt").alias("e"), C.matrix_tests["is_square"]("m").alias("m_square"), C.matrix_tests["is_symmetric"]("mt").alias("m_symmetric"))
    return found.select("vec_id", r6(F.col("d")).alias("m_det"), "m_rank", r6(C.trace("m")).alias("m_trace"), at("inv", 0, 1).alias("m_inv"), at("mt", 0, 1).alias("m_mult"), at("cube", 1, 0).alias("m_pow"), r6(F.get("e", F.lit(0))).alias("m_eigen"), "m_square", "m_symmetric", at(C.row_steps("m"), 0, 0).alias("m_step"))


_register(
    "matrix_scalars",
    matrix_scalars,
    """WITH e AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c, embedding[4]::DOUBLE AS d FROM embeddings), f AS (SELECT *, a * d - b * c AS t, a * a + b * b AS p, a * c + b * d AS q, c * c + d * d AS r FROM e)
    SELECT vec_id, round(t, 6) + 0.0 AS m_det, 2::BIGINT AS m_rank, round(a + d, 6) + 0.0 AS m_trace, round(-b / t, 6) + 0.0 AS m_inv, round(q, 6) + 0.0 AS m_mult, round(c * (a * a + b * c) + d * (c * a + d * c), 6) + 0.0 AS m_pow, round((p + r) / 2 + sqrt(power((p + r) / 2, 2) - (p * r - q * q)), 6) + 0.0 AS m_eigen, TRUE AS m_square, TRUE AS m_symmetric, round(c - a, 6) + 0.0 AS m_step FROM f""",
)
scalars(
    "color_scalars",
    "part",
    lambda: {"c_rgb": C.rgb(F.col("p_size") * 5, F.col("p_partkey") % 256, F.lit(7)), "c_alpha": C.rgb(F.col("p_size") * 5, F.lit(0), F.lit(255), F.col("p_size")), "c_new": C.with_transparency(F.lit("#2962FF"), F.col("p_size")), "c_red": C.channel(C.rgb(F.col("p_size") * 5, F.lit(1), F.lit(2)), 0).cast("long"), "c_grad": C.gradient(F.col("p_size"), F.lit(1.0), F.lit(50.0), "#000000", "#FFFF00")},
    "p_partkey",
    """SELECT p_partkey, printf('#%02X%02X07', least(p_size * 5, 255), p_partkey % 256) AS c_rgb, printf('#%02X00FF', least(p_size * 5, 255)) || printf('%02X', trunc(255 * (1 - p_size / 100.0))::INT) AS c_alpha, '#2962FF' || printf('%02X', trunc(255 * (1 - p_size / 100.0))::INT) AS c_new, least(p_size * 5, 255)::BIGINT AS c_red, printf('#%02X%02X00', trunc(255 * ((p_size - 1) / 49.0))::INT, trunc(255 * ((p_size - 1) / 49.0))::INT) AS c_grad FROM part""",
)

scalars(
    "map_scalars",
    "orders",
    lambda: (lambda m: {"p_get": C.map_get(m, "o_orderstatus", 0), "p_none": C.map_get(m, F.lit("?"), -1), "p_has": C.map_contains(m, F.lit("b")), "p_put": C.map_get(C.map_put(m, F.lit("b"), 7), F.lit("b"), 0), "p_new": C.map_size(C.map_put(m, F.lit("z"), 1)).cast("long"), "p_removed": C.map_size(C.map_remove(m, F.lit("a"))).cast("long"), "p_keys": F.array_join(C.map_keys(m), ",")})(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2), F.col("o_orderstatus"), F.lit(3))),
    "o_orderkey",
    "SELECT o_orderkey, 3 AS p_get, -1 AS p_none, TRUE AS p_has, 7 AS p_put, 4::BIGINT AS p_new, 2::BIGINT AS p_removed, 'a,b,' || o_orderstatus AS p_keys FROM orders",
)

# -- scripts and backtests ------------------------------------------------------------------------

CROSS = """//@version=5
indicator("Cross")
fast = ta.sma(close, 3)
slow = ta.sma(close, 8)
var int ups = 0
if ta.crossover(fast, slow)
    ups += 1
plot(fast, "fast")
plot(ups, "ups")
plot(math.sum(volume, 4), "volume4")
"""


def script_cross(spark, sf_dir):
    out = script.plots(hourly(spark, sf_dir), CROSS)
    return out.select("symbol", "bar_index", r6(F.col("plot_0")).alias("fast"), F.col("plot_1").cast("long").alias("ups"), r6(F.col("plot_2")).alias("volume4"))


_register("script_cross", script_cross, f"WITH {BARS}, a AS (SELECT *, {full('close', 3, f'avg(close) {win(3)}')} AS f, {full('close', 8, f'avg(close) {win(8)}')} AS s FROM bars), b AS (SELECT *, CASE WHEN coalesce(lag(f) {LINE} <= lag(s) {LINE} AND f > s, FALSE) THEN 1 ELSE 0 END AS up FROM a) SELECT symbol, bar_index::BIGINT AS bar_index, round(f, 6) + 0.0 AS fast, (sum(up) {win()})::BIGINT AS ups, round(sum(volume) {win(4)}, 6) + 0.0 AS volume4 FROM b")

DAILY = """//@version=5
indicator("Daily")
[c, m] = request.security(syminfo.tickerid, "D", [close, ta.sma(close, 3)])
plot(c, "close")
plot(m, "sma")
plot(request.security(syminfo.tickerid, "D", volume, lookahead=barmerge.lookahead_on), "volume")
"""


def script_security(spark, sf_dir):
    out = script.plots(hourly(spark, sf_dir), DAILY, chart_tf="60")
    return out.select("symbol", "bar_index", r6(F.col("plot_0")).alias("d_close"), r6(F.col("plot_1")).alias("d_sma"), r6(F.col("plot_2")).alias("d_volume"))


_register(
    "script_security",
    script_security,
    _DAYS
    + """, k AS (SELECT *, CASE WHEN h >= 2 THEN avg(close) OVER (PARTITION BY symbol ORDER BY h ROWS 2 PRECEDING) END AS sma FROM g)
    SELECT d.symbol, d.bar_index::BIGINT AS bar_index, round(k.close, 6) + 0.0 AS d_close, round(k.sma, 6) + 0.0 AS d_sma, round(n.volume, 6) + 0.0 AS d_volume FROM d JOIN g n ON n.symbol = d.symbol AND n.h = d.h LEFT JOIN k ON k.symbol = d.symbol AND k.h = d.h - 1""",
)

STATE = """//@version=5
indicator("State")
type Tally
    int up = 0
    float best = 0.0
method see(Tally t, float x) =>
    t.up := t.up + (x > nz(x[1], x) ? 1 : 0)
    t.best := math.max(t.best, x)
var t = Tally.new()
t.see(close)
var window = array.new<float>()
window.push(close)
if window.size() > 5
    window.shift()
var counts = map.new<int, int>()
k = int(volume)
counts.put(k, counts.get(k, 0) + 1)
float back = 0.0
for i = 0 to 2
    back += close[i]
kind = switch
    close > open => 1
    close < open => -1
    => 0
m = matrix.new<float>(2, 2, 0.0)
m.set(0, 0, high)
m.set(1, 1, low)
m.set(0, 1, 1.0)
plot(t.up, "up")
plot(t.best, "best")
plot(window.median(), "median")
plot(counts.get(k), "seen")
plot(back, "back")
plot(kind, "kind")
plot(m.det(), "det")
"""


def script_state(spark, sf_dir):
    out = script.plots(hourly(spark, sf_dir), STATE)
    return out.select("symbol", "bar_index", *[r6(F.col(f"plot_{i}")).alias(c) for i, c in enumerate(("up", "best", "median_", "seen", "back", "kind", "det"))])


_register(
    "script_state",
    script_state,
    f"""WITH {BARS}, a AS (SELECT *, CASE WHEN close > {lag('close')} THEN 1 ELSE 0 END AS u FROM bars)
    SELECT symbol, bar_index::BIGINT AS bar_index, round((sum(u) {win()})::DOUBLE, 6) + 0.0 AS up, round(greatest(0, max(close) {win()}), 6) + 0.0 AS best, round(median(close) {win(5)}, 6) + 0.0 AS median_, round((row_number() OVER (PARTITION BY symbol, volume ORDER BY bar_index))::DOUBLE, 6) + 0.0 AS seen, round(CASE WHEN bar_index >= 2 THEN sum(close) {win(3)} END, 6) + 0.0 AS back, round(sign(close - open)::DOUBLE, 6) + 0.0 AS kind, round(high * low, 6) + 0.0 AS det FROM a""",
)

STRATEGY = """//@version=5
strategy("Cross", initial_capital=10000, default_qty_value=2)
fast = ta.sma(close, 3)
slow = ta.sma(close, 8)
if ta.crossover(fast, slow)
    strategy.entry("L", strategy.long)
if ta.crossunder(fast, slow)
    strategy.close("L")
"""
_MARKS = f"""WITH {BARS}, a AS (SELECT *, {full('close', 3, f'avg(close) {win(3)}')} AS f, {full('close', 8, f'avg(close) {win(8)}')} AS s FROM bars), b AS (SELECT *, coalesce(lag(f) {LINE} <= lag(s) {LINE} AND f > s, FALSE) AS up, coalesce(lag(f) {LINE} >= lag(s) {LINE} AND f < s, FALSE) AS down FROM a),
c AS (SELECT *, CASE WHEN lag(up) {LINE} THEN 1 WHEN lag(down) {LINE} THEN 0 END AS mark FROM b), d AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) {win()}, 0) AS on_ FROM c), e AS (SELECT *, on_ - coalesce(lag(on_) {LINE}, 0) AS move FROM d)"""


def strategy_trades(spark, sf_dir):
    out = script.trades(hourly(spark, sf_dir), STRATEGY)
    return out.select("symbol", "trade", "entry_id", "entry_bar_index", "exit_bar_index", r6(F.col("entry_price")).alias("entry_price"), r6(F.col("exit_price")).alias("exit_price"), r6(F.col("profit")).alias("profit"), r6(F.col("size")).alias("size"))


_register(
    "strategy_trades",
    strategy_trades,
    _MARKS + """, i AS (SELECT symbol, bar_index, open, row_number() OVER (PARTITION BY symbol ORDER BY bar_index) - 1 AS trade FROM e WHERE move = 1), o AS (SELECT symbol, bar_index, open, row_number() OVER (PARTITION BY symbol ORDER BY bar_index) - 1 AS trade FROM e WHERE move = -1)
    SELECT symbol, trade, 'L' AS entry_id, i.bar_index::BIGINT AS entry_bar_index, o.bar_index::BIGINT AS exit_bar_index, round(i.open, 6) + 0.0 AS entry_price, round(o.open, 6) + 0.0 AS exit_price, round(2 * (o.open - i.open), 6) + 0.0 AS profit, 2.0::DOUBLE AS size FROM i JOIN o USING (symbol, trade)""",
)


def strategy_equity(spark, sf_dir):
    out = script.equity(hourly(spark, sf_dir), STRATEGY)
    return out.select("symbol", "bar_index", *[r6(F.col(c)).alias(c) for c in ("position_size", "equity", "netprofit", "openprofit")])


_register(
    "strategy_equity",
    strategy_equity,
    _MARKS + f""", g AS (SELECT *, last_value(CASE WHEN move = 1 THEN open END IGNORE NULLS) {win()} AS entry FROM e), h AS (SELECT *, sum(CASE WHEN move = -1 THEN 2 * (open - entry) ELSE 0 END) {win()} AS net, CASE WHEN on_ = 1 THEN 2 * (close - entry) ELSE 0 END AS op FROM g)
    SELECT symbol, bar_index::BIGINT AS bar_index, round(2.0 * on_, 6) + 0.0 AS position_size, round(10000 + net + op, 6) + 0.0 AS equity, round(net, 6) + 0.0 AS netprofit, round(op, 6) + 0.0 AS openprofit FROM h""",
)


#: Figures at the last close, from its row z, the trades' sums s, the extremes dd of equity and what equity was then, th.
SUMMED = {
    "position_size": "2.0 * on_", "position_avg_price": "CASE WHEN on_ = 1 THEN entry END", "equity": "10000 + net + op", "openprofit": "op", "openprofit_percent": "100 * op / (10000 + net)", "netprofit": "net", "netprofit_percent": "net / 100", "grossprofit": "gains", "grossprofit_percent": "gains / 100", "grossloss": "losses", "grossloss_percent": "losses / 100", "closedtrades": "n", "opentrades": "on_", "wintrades": "won", "losstrades": "lost", "eventrades": "n - won - lost", "avg_trade": "a", "avg_trade_percent": "ap", "avg_winning_trade": "w", "avg_winning_trade_percent": "wp", "avg_losing_trade": "l", "avg_losing_trade_percent": "lp", "max_drawdown": "down", "max_drawdown_percent": "100 * down / peak_then", "max_runup": "up", "max_runup_percent": "100 * up / trough_then", "max_contracts_held_all": "2 * held", "max_contracts_held_long": "2 * held", "max_contracts_held_short": "0", "initial_capital": "10000", "default_qty_value": "2",
}


def strategy_summary(spark, sf_dir):
    return script.summary(hourly(spark, sf_dir), STRATEGY).select("symbol", "name", r6(F.col("value")).alias("value"))


_register(
    "strategy_summary",
    strategy_summary,
    _MARKS
    + f""", g AS (SELECT *, last_value(CASE WHEN move = 1 THEN open END IGNORE NULLS) {win()} AS entry FROM e), h AS (SELECT *, sum(CASE WHEN move = -1 THEN 2 * (open - entry) ELSE 0 END) {win()} AS net, CASE WHEN on_ = 1 THEN 2 * (close - entry) ELSE 0 END AS op FROM g),
    pk AS (SELECT *, greatest(10000, max(10000 + net + op) {win()}) AS peak, least(10000, min(10000 + net + op) {win()}) AS trough, 10000 + net + op AS eq FROM h),
    dd AS (SELECT symbol, max(peak - eq) AS down, max(eq - trough) AS up, max(on_) AS held FROM pk GROUP BY 1),
    th AS (SELECT pk.symbol, arg_min(peak, bar_index) FILTER (WHERE peak - eq = dd.down) AS peak_then, arg_min(trough, bar_index) FILTER (WHERE eq - trough = dd.up) AS trough_then FROM pk JOIN dd ON pk.symbol = dd.symbol GROUP BY 1),
    z AS (SELECT symbol, arg_max(net, bar_index) AS net, arg_max(op, bar_index) AS op, arg_max(on_, bar_index) AS on_, arg_max(entry, bar_index) AS entry FROM h GROUP BY 1),
    tr AS (SELECT symbol, 2 * (open - entry) AS p, (open - entry) / entry * 100 AS pp FROM g WHERE move = -1),
    s AS (SELECT symbol, count(*) AS n, count(*) FILTER (WHERE p > 0) AS won, count(*) FILTER (WHERE p < 0) AS lost, coalesce(sum(p) FILTER (WHERE p > 0), 0) AS gains, coalesce(-sum(p) FILTER (WHERE p < 0), 0) AS losses, avg(p) AS a, avg(pp) AS ap, avg(p) FILTER (WHERE p > 0) AS w, avg(pp) FILTER (WHERE p > 0) AS wp, avg(-p) FILTER (WHERE p < 0) AS l, avg(-pp) FILTER (WHERE p < 0) AS lp FROM tr GROUP BY 1),
    y AS (SELECT z.symbol, {', '.join(f'({v})::DOUBLE AS {k}' for k, v in SUMMED.items())}
      FROM z JOIN s USING (symbol) JOIN dd USING (symbol) JOIN th USING (symbol))
    SELECT symbol, name, round(value, 6) + 0.0 AS value FROM (FROM y UNPIVOT INCLUDE NULLS (value FOR name IN ({', '.join(SUMMED)})))""",
)

DRAWN = """//@version=5
indicator("Marks", overlay=true)
if bar_index % 50 == 0
    l = label.new(bar_index, high, str.tostring(bar_index))
    label.set_y(l, low)
plotshape(close > open, "up")
bgcolor(close > open ? color.new(color.green, 80) : na)
"""


def script_drawings(spark, sf_dir):
    out = script.drawings(hourly(spark, sf_dir), DRAWN)
    return out.select("symbol", "bar_index", "kind", F.get_json_object("state", "$.text").alias("text"), r6(F.get_json_object("state", "$.y").cast("double")).alias("y"))


_register("script_drawings", script_drawings, f"WITH {BARS} SELECT symbol, bar_index::BIGINT AS bar_index, 'label' AS kind, bar_index::VARCHAR AS text, round(low, 6) + 0.0 AS y FROM bars WHERE bar_index % 50 = 0")


_IF = "//@version=5\nindicator('c')\nx = 0\n{}\n    x := 1\n{}\nplot(x)\n"
#: name -> (script, whether it compiles)
CHECKED = {
    "cross": (CROSS, True),
    "strategy": (STRATEGY, True),
    "drawn": (DRAWN, True),
    "broken": ("x = (1", False),
    "unknown_name": ("plot(nothing_of_that_name)", False),
    "never_declared": ("x := 1", False),
    "missing_argument": ("plot(ta.sma(close))", False),
    "lazy_in_first_condition": (_IF.format("if close > 2 and ta.crossover(close, open)", "else\n    x := 2"), True),
    "first_in_further_condition": (_IF.format("if close > 2", "else if ta.crossover(close, open) and close > 3\n    x := 2"), True),
    "lazy_in_further_condition": (_IF.format("if close > 1", "else if close > 2 and ta.crossover(close, open)\n    x := 2"), False),
    "choice_in_further_condition": (_IF.format("if close > 1", "else if (close > 2 ? ta.rising(close, 2) : false)\n    x := 2"), False),
    "lazy_in_while": (_IF.format("while x < 1 and ta.rising(close, 2)", ""), False),
    "direct_in_while": (_IF.format("while ta.rising(close, 2) and x < 1", ""), True),
    "lazy_in_case": ("//@version=5\nindicator('c')\nx = switch\n    close > 1 or ta.falling(close, 2) => 1\n    => 2\nplot(x)\n", False),
    "named_before": ("//@version=5\nindicator('c')\nc = ta.crossover(close, open)\nx = switch\n    close > 1 or c => 1\n    => 2\nplot(x)\n", True),
}


def script_check(spark, sf_dir):
    texts = spark.createDataFrame([(k, text) for k, (text, _) in CHECKED.items()], "path string, value string")
    return script.check(texts).select("name", "ok")


_register("script_check", script_check, "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {str(ok).upper()})" for k, (_, ok) in CHECKED.items()) + ") t(name, ok)")


def hourly_cross(spark, sf_dir):
    """Flagship: hourly bars, a moving average and a smoothed one, and where they cross."""
    rows = scan.scan(hourly(spark, sf_dir), scan.op("ema", 9))
    s = Study(rows)
    slow = s.hold(s.sma("close", 14))
    out = s.result(sma=slow, over=s.crossover("ema", slow))
    return out.select("symbol", F.col("bar_index").cast("long").alias("bar_index"), r6(F.col("close")).alias("close"), r6(F.col("ema")).alias("ema"), r6(F.col("sma")).alias("sma"), "over")


_register(
    "hourly_cross",
    hourly_cross,
    f"WITH RECURSIVE {BARS}, " + smooth("a", "bars", {"ema": ema_("close", 9)}) + f", b AS (SELECT *, {full('close', 14, f'avg(close) {win(14)}')} AS slow FROM a) SELECT symbol, bar_index::BIGINT AS bar_index, round(close, 6) + 0.0 AS close, round(ema, 6) + 0.0 AS ema, round(slow, 6) + 0.0 AS sma, coalesce({lag('ema')} <= {lag('slow')} AND ema > slow, FALSE) AS over FROM b",
)

ORACLE_SQL = {k: v.replace(", 6) + 0.0", f" + {NUDGE!r}, 6) + 0.0") for k, v in ORACLE_SQL.items()}
