"""Registered queries of scripts, backtests, other timeframes, containers and streams, with their SQL.

Rounding and na are as in ``queries``, which these rest on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell import queries as Q
from tidewell.functions import columns as C
from tidewell.operators import htf, scan
from tidewell.operators.study import Study
from tidewell.plans import script
from tidewell.queries import BARS, LINE, NUDGE, ema_, hourly, lag, r6, rounded, smooth, table, win
from tidewell.sources import bars as B
from tidewell.streaming import bars as S


def register(name: str, query, sql: str) -> None:
    Q._register(name, query, sql.replace(", 6) + 0.0", f" + {NUDGE!r}, 6) + 0.0"))


def rd(x: str) -> str:
    return f"round(({x})::DOUBLE, 6) + 0.0"


def scripted(name: str, source: str, shown: dict[str, str], ctes: str = "", rows: str = "bars", inputs: dict | None = None) -> None:
    """A query of a script's plots over hourly bars, in their order, and the SQL of each; ctes follow ``bars``, rows are what shown is read from."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = script.plots(hourly(spark, sf_dir), source, inputs, chart_tf="60")
        return out.select("symbol", "bar_index", *[r6(F.col(f"plot_{i}")).alias(c) for i, c in enumerate(shown)])

    register(name, query, f"WITH {BARS}{ctes} SELECT symbol, bar_index::BIGINT AS bar_index, " + ", ".join(f"{rd(v)} AS {c}" for c, v in shown.items()) + f" FROM {rows}")


# -- scripts --------------------------------------------------------------------------------------

LOGIC = """//@version=5
indicator("Logic")
up = close > open
big = volume > 2
plot(up and big ? 1 : 0, "both")
plot(up or big ? 1 : 0, "either")
plot(not up ? 1 : 0, "neither")
x = 0
while x < 20
    x += 3
    if x == 6
        continue
    if x > 8
        break
plot(x, "left")
var int n = 0
var int k = 0
var int m = 0
if bar_index == 0
    while n < 20000
        n += 1
    for i = 1 to 30000
        k += 1
    many = array.new<int>(12000, 1)
    for v in many
        m += v
plot(n, "in_while")
plot(k, "in_for")
plot(m, "in_for_in")
plot(hour[1], "hour_before")
plot((time - time[2]) / 3600000, "hours")
float prod = 1.0
for i = 3 to 1 by -1
    prod *= i + close / 1000
plot(prod, "down")
"""
scripted(
    "script_logic",
    LOGIC,
    {
        "both": "CASE WHEN close > open AND volume > 2 THEN 1 ELSE 0 END", "either": "CASE WHEN close > open OR volume > 2 THEN 1 ELSE 0 END", "neither": "CASE WHEN close > open THEN 0 ELSE 1 END", "left_": "9", "in_while": "10000", "in_for": "10000", "in_for_in": "12000",
        "hour_before": f"lag(hour(time)) {LINE}", "hours": f"(time_ms - lag(time_ms, 2) {LINE}) // 3600000", "down": "(3 + close / 1000) * (2 + close / 1000) * (1 + close / 1000)",
    },
)

LIBRARY = """//@version=5
library("Tools")
import someone/other/1 as other
export double(float x) => x * 2
export spread(float a, float b = 1.0) => a - b
method half(float x) => x / 2
count() =>
    var int n = 0
    n += 1
    n
plot(double(close), "double")
plot(spread(high, low), "spread")
plot(spread(open), "less")
plot(close.half(), "half")
a = count()
b = bar_index % 3 == 0 ? count() : 0
c = 0
if bar_index % 3 == 0
    c := count()
log.info("bar")
alert("seen")
alertcondition(close > open, "up")
plot(a, "always")
plot(b, "chosen")
plot(c, "taken")
"""
scripted("script_library", LIBRARY, {"twice": "close * 2", "spread": "high - low", "less": "open - 1", "half": "close / 2", "always": "bar_index + 1", "chosen": "CASE WHEN bar_index % 3 = 0 THEN bar_index + 1 ELSE 0 END", "taken": "CASE WHEN bar_index % 3 = 0 THEN bar_index // 3 + 1 ELSE 0 END"})

ENVIRONMENT = """//@version=5
indicator("Environment")
len = input.int(4, "Length")
src = input.source(close, "Source")
on = input.bool(true, "On")
tf = input.timeframe("D", "Frame")
mult = input.float(1.5, "Mult")
name = input.string("a", "Name")
plot(ta.sma(src, len) * mult, "sma")
plot(on and name == "a" ? 1 : 0, "on")
plot(timeframe.in_seconds("W"), "week")
plot(timeframe.in_seconds(), "chart")
plot(timeframe.from_seconds(3600) == "60" ? 1 : 0, "from")
plot(timeframe.change("D") ? 1 : 0, "change")
plot(timeframe.multiplier, "multiplier")
plot(timeframe.isintraday ? 1 : 0, "intraday")
plot(timeframe.isdaily ? 1 : 0, "daily")
plot(syminfo.mintick, "mintick")
plot(syminfo.ticker == "TEST" ? 1 : 0, "ticker")
plot(ticker.new("A", "B") == "A:B" ? 1 : 0, "made")
plot(ticker.heikinashi("A:B") == "A:B" ? 1 : 0, "kept")
plot(chart.is_standard ? 1 : 0, "standard")
plot(request.dividends("A:B") + request.splits("A:B") + request.earnings("A:B"), "zero")
plot(request.financial("A:B", "X", "FY"), "none")
plot(request.currency_rate("USD", "USD"), "rate")
plot(na(request.currency_rate("USD", "EUR")) ? 1 : 0, "no_rate")
plot(array.get(request.security_lower_tf(syminfo.tickerid, "1", close), 0), "lower")
plot(request.security(syminfo.tickerid, tf, close)[1], "before")
plot(math.pi + math.e + math.phi + math.rphi, "constants")
"""
_DAY_OF = ", " + Q._DAYS[len(f"WITH {BARS}, ") :] + ", dk AS (SELECT d.*, k.close AS day_close FROM d LEFT JOIN g k ON k.symbol = d.symbol AND k.h = d.h - 1)"
scripted(
    "script_environment",
    ENVIRONMENT,
    {
        "sma": f"1.5 * {Q.full('high', 3, f'avg(high) {win(3)}')}", "on_": "1", "week": "604800", "chart": "3600", "from_": "1", "change": "0", "multiplier": "60", "intraday": "1", "daily": "0", "mintick": "0.01", "ticker": "1", "made": "1", "kept": "1", "standard": "1", "zero": "0", "none_": "NULL", "rate": "1", "no_rate": "1", "lower_": "close", "before": f"lag(day_close) {LINE}",
        "constants": "pi() + exp(1) + (1 + sqrt(5)) / 2 + (sqrt(5) - 1) / 2",
    },
    _DAY_OF,
    "dk",
    {"Length": 3, "Source": "high"},
)

PLOTTED = """//@version=5
indicator("Plots", overlay=true)
p1 = plot(close, "close", color=close > open ? color.green : color.red)
p2 = plot(open, "open")
fill(p1, p2, color=color.new(color.blue, 90))
plotshape(close > open, "up", color=color.lime)
plotchar(close < open, "down")
plotarrow(close - open, "arrow")
plotcandle(open, high, low, close, "candle", color=close > open ? color.teal : na)
plotbar(open, high, low, close, "bar")
bgcolor(volume > 2 ? color.rgb(255, 0, 0, 80) : na)
barcolor(close > open ? color.white : color.black)
h1 = hline(50, "level")
plot(color.r(color.from_gradient(close, 0, 100, #000000, #FF0000)), "red")
"""


def script_plots(spark, sf_dir):
    out = script.run(hourly(spark, sf_dir), PLOTTED)
    values = {"close_": 0, "open_": 1, "up": 3, "down": 4, "arrow": 5, "level": 10, "red": 11}
    return out.select("symbol", "bar_index", *[r6(F.col(f"plot_{i}")).alias(c) for c, i in values.items()], *[F.col("colors")[i].alias(f"color_{i}") for i in (0, 2, 3, 6, 8, 9)])


register(
    "script_plots",
    script_plots,
    f"""WITH {BARS} SELECT symbol, bar_index::BIGINT AS bar_index, {rd('close')} AS close_, {rd('open')} AS open_, {rd('CASE WHEN close > open THEN 1 ELSE 0 END')} AS up, {rd('CASE WHEN close < open THEN 1 ELSE 0 END')} AS down, {rd('close - open')} AS arrow, {rd('50')} AS level, {rd('trunc(255 * least(1, greatest(0, close / 100)))')} AS red,
    CASE WHEN close > open THEN '#4CAF50' ELSE '#FF5252' END AS color_0, '#2962FF19' AS color_2, '#00E676' AS color_3, CASE WHEN close > open THEN '#00897B' END AS color_6, CASE WHEN volume > 2 THEN '#FF000032' END AS color_8, CASE WHEN close > open THEN '#FFFFFF' ELSE '#363A45' END AS color_9 FROM bars""",
)

SHAPES = """//@version=5
indicator("Shapes", overlay=true)
if bar_index % 60 == 10
    l = line.new(bar_index, low, bar_index + 10, high)
    line.set_y2(l, close)
    line.set_width(l, 3)
    b = box.new(bar_index - 5, high, bar_index, low)
    box.set_top(b, high + 1)
    c = label.new(bar_index, close, "here")
    d = label.copy(c)
    label.set_y(d, line.get_price(l, bar_index + 5))
    label.set_text(d, str.tostring(label.get_x(c)))
    label.delete(c)
    p = chart.point.from_index(bar_index, open)
    q = chart.point.from_index(bar_index + 3, high)
    m = line.new(p, q)
    t = table.new(position.top_right, 2, 2)
    table.cell(t, 0, 0, "x")
"""


def script_shapes(spark, sf_dir):
    out = script.drawings(hourly(spark, sf_dir), SHAPES)
    first = lambda *names: r6(F.coalesce(*[F.get_json_object("state", f"$.{n}").cast("double") for n in names]))
    return out.select("symbol", "bar_index", "kind", "id", first("x1", "left", "x").alias("a"), first("y1", "top", "y").alias("b"), first("x2", "right").alias("c"), first("y2", "bottom").alias("d"), F.get_json_object("state", "$.text").alias("text"), F.get_json_object("state", "$.width").cast("long").alias("width"))


register(
    "script_shapes",
    script_shapes,
    f"""WITH {BARS}, e AS (SELECT *, (bar_index - 10) // 60 * 6 AS id FROM bars WHERE bar_index % 60 = 10), x AS (
    SELECT symbol, bar_index, 'line' AS kind, id, bar_index::DOUBLE AS a, low AS b, bar_index + 10.0 AS c, close AS d, NULL AS text, 3 AS width FROM e
    UNION ALL SELECT symbol, bar_index, 'box', id + 1, bar_index - 5, high + 1, bar_index, low, NULL, NULL FROM e
    UNION ALL SELECT symbol, bar_index, 'label', id + 2, bar_index, close, NULL, NULL, 'here', NULL FROM e
    UNION ALL SELECT symbol, bar_index, 'label', id + 3, bar_index, low + 5 * (close - low) / 10, NULL, NULL, bar_index::VARCHAR, NULL FROM e
    UNION ALL SELECT symbol, bar_index, 'line', id + 4, bar_index, open, bar_index + 3, high, NULL, NULL FROM e
    UNION ALL SELECT symbol, bar_index, 'table', id + 5, NULL, NULL, NULL, NULL, NULL, NULL FROM e)
    SELECT symbol, bar_index::BIGINT AS bar_index, kind, id::BIGINT AS id, {rd('a')} AS a, {rd('b')} AS b, {rd('c')} AS c, {rd('d')} AS d, text, width::BIGINT AS width FROM x""",
)

FINAL = """//@version=5
indicator("Final")
var int ups = 0
var float top = na
var string mark = "none"
if close > open
    ups += 1
top := math.max(nz(top, high), high)
mark := close > open ? "up" : "down"
"""


def script_final(spark, sf_dir):
    return script.final(hourly(spark, sf_dir), FINAL)


register(
    "script_final",
    script_final,
    f"""WITH {BARS}, t AS (SELECT symbol, count(*) FILTER (WHERE close > open) AS ups, max(high) AS top, arg_max(CASE WHEN close > open THEN 'up' ELSE 'down' END, bar_index) AS mark FROM bars GROUP BY 1)
    SELECT symbol, 'ups' AS name, ups::VARCHAR AS value FROM t UNION ALL SELECT symbol, 'top', top::DOUBLE::VARCHAR FROM t UNION ALL SELECT symbol, 'mark', '"' || mark || '"' FROM t""",
)

LOWERED = """//@version=5
indicator("Lowered")
len = input.int(5, "Length")
change(float x) =>
    x - x[1]
f = ta.sma(close, len)
[mid, top, bottom] = ta.bb(close, 10, 2)
var int ups = 0
var float best = 0.0
var float held = na
if ta.crossover(close, f)
    ups += 1
if close > open and volume > 1
    held := close
else if volume > 3
    best := math.max(best, high)
kind = switch
    close > top => 2
    close < bottom => -2
    => 0
state = if close > f
    1
else
    -1
plot(f, "mean")
plot(ups, "ups")
plot(best, "best")
plot(held, "held")
plot(kind, "kind")
plot(state, "state")
plot(change(f), "change")
plot(ta.highest(len) - ta.lowest(len), "range")
plot(bar_index / 7, "sevenths")
plot(math.round(nz(f[3], -1), 2), "rounded")
plot(math.sum(close > open ? 1 : 0, 4), "four")
plotshape(ta.rising(close, 2), "rising")
"""
scripted(
    "script_lowered",
    LOWERED,
    {
        "mean": "f", "ups": f"sum(CASE WHEN coalesce(lag_c <= lag_f AND close > f, FALSE) THEN 1 ELSE 0 END) {win()}", "best": f"greatest(0, max(CASE WHEN NOT (close > open AND volume > 1) AND volume > 3 THEN high END) {win()})", "held": f"last_value(CASE WHEN close > open AND volume > 1 THEN close END IGNORE NULLS) {win()}",
        "kind": "CASE WHEN close > m + 2 * d THEN 2 WHEN close < m - 2 * d THEN -2 ELSE 0 END", "state": "CASE WHEN close > f THEN 1 ELSE -1 END", "change": "f - lag_f", "range_": f"CASE WHEN bar_index >= 4 THEN max(high) {win(5)} - min(low) {win(5)} END", "sevenths": "bar_index // 7", "rounded": f"floor(abs(coalesce(lag(f, 3) {LINE}, -1)) * 100 + 0.5) / 100 * sign(coalesce(lag(f, 3) {LINE}, -1))", "four": f"sum(CASE WHEN close > open THEN 1 ELSE 0 END) {win(4)}",
        "rising": f"CASE WHEN close > lag_c AND lag_c > lag(close, 2) {LINE} THEN 1 ELSE 0 END",
    },
    f", a AS (SELECT *, {Q.full('close', 5, f'avg(close) {win(5)}')} AS f, {Q.full('close', 10, f'avg(close) {win(10)}')} AS m, {Q.full('close', 10, f'stddev_pop(close) {win(10)}')} AS d, {lag('close')} AS lag_c FROM bars), b AS (SELECT *, {lag('f')} AS lag_f FROM a)",
    "b",
)

# -- other timeframes -----------------------------------------------------------------------------

FRAMES = {"15": "epoch(time)::BIGINT // 900", "240": "epoch(time)::BIGINT // 14400", "2D": "epoch(time)::BIGINT // 172800", "W": "epoch(date_trunc('week', time)::TIMESTAMP)::BIGINT", "M": "epoch(date_trunc('month', time)::TIMESTAMP)::BIGINT"}


def frame(name: str, tf: str, rows: str = "bars") -> str:
    """CTEs: bars with the period's number, and the periods' bars."""
    key = FRAMES.get(tf, tf)
    return f"""{name}_d AS (SELECT *, dense_rank() OVER (PARTITION BY symbol ORDER BY {key}) - 1 AS h FROM {rows}),
    {name} AS (SELECT symbol, h, min(time_ms) AS time_ms, arg_min(open, bar_index) AS open, max(high) AS high, min(low) AS low, arg_max(close, bar_index) AS close, sum(volume) AS volume FROM {name}_d GROUP BY 1, 2)"""


def htf_frames(spark, sf_dir):
    out = None
    for tf in FRAMES:
        one = htf.higher(hourly(spark, sf_dir), tf, timed=True).select(F.lit(tf).alias("tf"), "symbol", F.col("bar_index").cast("long").alias("bar_index"), "time_ms", "open", "high", "low", "close", "volume", "time_close")
        out = one if out is None else out.unionByName(one)
    return out


register(
    "htf_frames",
    htf_frames,
    f"WITH {BARS}, " + ", ".join(frame(f"f{i}", tf) for i, tf in enumerate(FRAMES)) + " " + " UNION ALL ".join(f"SELECT '{tf}' AS tf, symbol, h::BIGINT AS bar_index, time_ms, open, high, low, close, volume, coalesce(lead(time_ms) OVER w{i}, 2 * time_ms - lag(time_ms) OVER w{i}, time_ms)::BIGINT AS time_close FROM f{i} WINDOW w{i} AS (PARTITION BY symbol ORDER BY h)" for i, tf in enumerate(FRAMES)),
)


def security_frames(spark, sf_dir):
    out = htf.security(hourly(spark, sf_dir), "240", {"c4": "close", "s4": lambda s: s.highest("high", 2)}, timed=True)
    out = htf.security(out, "W", {"w_high": "high"}, lookahead=True, timed=True)
    return out.select("symbol", F.col("bar_index").cast("long").alias("bar_index"), *[r6(F.col(c)).alias(c) for c in ("c4", "s4", "w_high")])


register(
    "security_frames",
    security_frames,
    f"WITH {BARS}, {frame('q', '240')}, {frame('w', 'W')}, qq AS (SELECT *, CASE WHEN h >= 1 THEN greatest(high, lag(high) OVER (PARTITION BY symbol ORDER BY h)) END AS s4 FROM q) SELECT a.symbol, a.bar_index::BIGINT AS bar_index, {rd('qq.close')} AS c4, {rd('qq.s4')} AS s4, {rd('w.high')} AS w_high FROM q_d a JOIN w_d b ON a.symbol = b.symbol AND a.bar_index = b.bar_index JOIN w ON w.symbol = b.symbol AND w.h = b.h LEFT JOIN qq ON qq.symbol = a.symbol AND qq.h = a.h - 1",
)

FRAMED = """//@version=5
indicator("Frames")
quarter = high - low
plot(request.security(syminfo.tickerid, "240", ta.sma(quarter, 2)), "four")
plot(request.security(syminfo.tickerid, "W", close[1], lookahead=barmerge.lookahead_on), "week")
plot(request.security(syminfo.tickerid, "240", volume, gaps=barmerge.gaps_on), "gap")
"""
scripted(
    "script_frames",
    FRAMED,
    {"four": "four", "week": "week", "gap": f"CASE WHEN coalesce(lag(h) {LINE} <> h, TRUE) THEN vol END"},
    f", {frame('q', '240')}, {frame('w', 'W')}, qq AS (SELECT *, CASE WHEN h >= 1 THEN avg(high - low) OVER (PARTITION BY symbol ORDER BY h ROWS 1 PRECEDING) END AS four FROM q), ww AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY h) AS back FROM w), z AS (SELECT a.symbol, a.bar_index, a.h, qq.four, qq.volume AS vol, ww.back AS week FROM q_d a JOIN w_d b ON a.symbol = b.symbol AND a.bar_index = b.bar_index JOIN ww ON ww.symbol = b.symbol AND ww.h = b.h LEFT JOIN qq ON qq.symbol = a.symbol AND qq.h = a.h - 1)",
    "z",
)


def untimed(spark, sf_dir) -> DataFrame:
    """The hourly bars without a time channel."""
    return B.from_table(hourly(spark, sf_dir).select("symbol", "bar_index", *B.PRICES), F.col("symbol"), None, F.col("bar_index"))


UNTIMED = """//@version=5
indicator("Untimed")
plot(request.security(syminfo.tickerid, "5", close), "five")
plot(hour, "hour")
"""


def security_untimed(spark, sf_dir):
    rows = htf.security(untimed(spark, sf_dir), "5", {"c5": "close", "v5": "volume"})
    by_script = script.plots(untimed(spark, sf_dir), UNTIMED).select("symbol", "bar_index", r6(F.col("plot_0")).alias("five"), r6(F.col("plot_1")).alias("hour_"))
    return rows.select("symbol", F.col("bar_index").cast("long").alias("bar_index"), r6(F.col("c5")).alias("c5"), r6(F.col("v5")).alias("v5")).join(by_script, ["symbol", "bar_index"])


register("security_untimed", security_untimed, f"WITH {BARS}, {frame('q', 'bar_index // 5')} SELECT a.symbol, a.bar_index::BIGINT AS bar_index, {rd('q.close')} AS c5, {rd('q.volume')} AS v5, {rd('q.close')} AS five, {rd('0')} AS hour_ FROM q_d a LEFT JOIN q ON q.symbol = a.symbol AND q.h = a.h - 1")

# -- further series ---------------------------------------------------------------------------------

_P = {level: i for i, level in enumerate(Q.LEVELS)}
#: (kind, developing) -> the levels that are shown, with their SQL from o, h, l, c of the period before, n the open of this one; of the running period where developing.
PIVOTS = {
    ("Fibonacci", False): {"p": "(h + l + c) / 3", "r1": "(h + l + c) / 3 + 0.382 * (h - l)", "s2": "(h + l + c) / 3 - 0.618 * (h - l)", "r3": "(h + l + c) / 3 + (h - l)"},
    ("Woodie", False): {"p": "(h + l + 2 * n) / 4", "r1": "(h + l + 2 * n) / 2 - l", "s2": "(h + l + 2 * n) / 4 - (h - l)", "r4": "h + 2 * ((h + l + 2 * n) / 4 - l) + (h - l)", "s3": "l - 2 * (h - (h + l + 2 * n) / 4)"},
    ("Classic", False): {"r1": "2 * (h + l + c) / 3 - l", "s1": "2 * (h + l + c) / 3 - h", "r4": "(h + l + c) / 3 + 3 * (h - l)", "s3": "(h + l + c) / 3 - 2 * (h - l)"},
    ("DM", False): {"p": "x / 4", "r1": "x / 2 - l", "s1": "x / 2 - h"},
    ("Camarilla", False): {"r1": "c + 1.1 * (h - l) / 12", "s3": "c - 1.1 * (h - l) / 4", "r5": "c + 1.1 * (h - l) / 2 + 1.168 * 1.1 * (h - l) / 4", "s5": "c - 1.1 * (h - l) / 2 - 1.168 * 1.1 * (h - l) / 4"},
    ("Traditional", True): {"p": "(h + l + c) / 3", "r1": "2 * (h + l + c) / 3 - l", "s2": "(h + l + c) / 3 - (h - l)"},
    ("Camarilla", True): {"r2": "c + 1.1 * (h - l) / 6", "s4": "c - 1.1 * (h - l) / 2"},
}


def pivot_kinds(spark, sf_dir):
    s = Study(hourly(spark, sf_dir))
    anchor = F.col("bar_index") % 24 == 0
    made = {f"{kind.lower()}{'_now' if now else ''}": (s.pivot_point_levels(kind, anchor, now), levels) for (kind, now), levels in PIVOTS.items()}
    out = s.result(**{k: x for k, (x, _) in made.items()})
    return out.select("symbol", F.col("bar_index").cast("long").alias("bar_index"), *[r6(F.get(k, F.lit(_P[level]))).alias(f"{k}_{level}") for k, (_, levels) in made.items() for level in levels])


register(
    "ta_pivot_point_kinds",
    pivot_kinds,
    f"""WITH {BARS}, g AS (SELECT *, bar_index // 24 AS g FROM bars), k AS (SELECT symbol, g, max(high) AS h, min(low) AS l, arg_max(close, bar_index) AS c, arg_min(open, bar_index) AS o FROM g GROUP BY 1, 2),
    j AS (SELECT g.symbol, g.bar_index, k.h, k.l, k.c, k.o, m.o AS n, k.h + k.l + k.c + CASE WHEN k.o = k.c THEN k.c WHEN k.c > k.o THEN k.h ELSE k.l END AS x FROM g JOIN k m ON m.symbol = g.symbol AND m.g = g.g LEFT JOIN k ON k.symbol = g.symbol AND k.g = g.g - 1),
    r AS (SELECT symbol, bar_index, max(high) OVER w AS h, min(low) OVER w AS l, close AS c FROM g WINDOW w AS (PARTITION BY symbol, g ORDER BY bar_index ROWS UNBOUNDED PRECEDING)),
    a AS (SELECT symbol, bar_index, """
    + ", ".join(f"{sql} AS {kind.lower()}_{level}" for (kind, now), levels in PIVOTS.items() if not now for level, sql in levels.items())
    + " FROM j), b AS (SELECT symbol, bar_index, "
    + ", ".join(f"{sql} AS {kind.lower()}_now_{level}" for (kind, now), levels in PIVOTS.items() if now for level, sql in levels.items())
    + " FROM r) SELECT symbol, bar_index::BIGINT AS bar_index, "
    + ", ".join(f"{rd(c)} AS {c}" for (kind, now), levels in PIVOTS.items() for level in levels for c in [f"{kind.lower()}{'_now' if now else ''}_{level}"])
    + " FROM a JOIN b USING (symbol, bar_index)",
)


def variable_windows(spark, sf_dir):
    rows = hourly(spark, sf_dir).withColumn("n", (F.col("bar_index") % 5 + 1).cast("double"))
    ops = [scan.op("vwma", "n"), scan.op("percentile_nearest_rank", "n", 75.0, to="nearest"), scan.op("percentile_linear_interpolation", "n", 30.0, to="linear"), scan.op("pivothigh", "n", 1), scan.op("pivotlow", 2, "n")]
    return scan.scan(rows, *ops).select("symbol", F.col("bar_index").cast("long").alias("bar_index"), *[r6(F.col(o[3][0])).alias("v_" + o[3][0]) for o in ops])


register(
    "ta_variable_windows",
    variable_windows,
    f"""WITH {BARS}, a AS (SELECT *, bar_index % 5 + 1 AS n, list(close) {win(8)} AS l, list(close * volume) {win(8)} AS pv, list(volume) {win(8)} AS vs FROM bars),
    b AS (SELECT *, CASE WHEN n <= len(l) THEN list_sort(l[len(l) - n + 1:]) END AS s, CASE WHEN n <= len(l) THEN list_sum(pv[len(l) - n + 1:]) / nullif(list_sum(vs[len(l) - n + 1:]), 0) END AS vwma, CASE WHEN n + 2 <= len(l) THEN l[len(l) - n - 1:] END AS hi, CASE WHEN n + 3 <= len(l) THEN l[len(l) - n - 2:] END AS lo, 0.3 * (n - 1) AS r FROM a)
    SELECT symbol, bar_index::BIGINT AS bar_index, {rd('vwma')} AS v_vwma, {rd('s[greatest(1, ceil(0.75 * n)::INT)]')} AS v_nearest, {rd('s[floor(r)::INT + 1] + (s[least(n, floor(r)::INT + 2)] - s[floor(r)::INT + 1]) * (r - floor(r))')} AS v_linear,
    {rd('CASE WHEN list_max(hi) = hi[n + 1] THEN hi[n + 1] END')} AS v_pivothigh, {rd('CASE WHEN list_min(lo) = lo[3] THEN lo[3] END')} AS v_pivotlow FROM b""",
)

# -- containers -------------------------------------------------------------------------------------


def some(a, n: int = 6):
    """The first elements as text."""
    return F.array_join(F.transform(C.array_slice(a, 0, n), lambda v: v.cast("long").cast("string")), ",")


def array_edits(spark, sf_dir):
    b = F.transform("embedding", lambda v: F.floor(v.cast("double") * 4).cast("double"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", b.alias("b"))
    x, v = F.col("b"), lambda i: F.get(F.col("b"), F.lit(i))
    made = {
        "mode_": C.array_mode(x), "at_first": C.index_of(x, v(0)).cast("double"), "at_last": C.last_index_of(x, v(0)).cast("double"), "from_left": C.binary_search(F.array_sort(x), v(3), "leftmost").cast("double"), "from_right": C.binary_search(F.array_sort(x), v(3), "rightmost").cast("double"), "popped": C.get(C.array_without(x, -1), F.size(x) - 2), "pushed": C.get(C.array_push(x, F.lit(6.0)), F.size(x)), "total_abs": C.array_sum(C.array_abs(x)), "new_sum": C.array_sum(C.array_new(3, F.lit(1.5))), "largest": C.get(C.array_sort(x, True), F.lit(0)),
        "joined_size": F.size(F.concat(x, x)).cast("double"), "last_": C.get(x, F.size(x) - 1),
    }
    texts = {"set_": some(C.array_set(x, 2, F.lit(9.0))), "inserted": some(C.array_insert(x, 1, F.lit(7.0))), "shifted": some(C.array_without(x, 0)), "removed": some(C.array_without(x, 2)), "filled": some(C.array_fill(x, F.lit(5.0), 1, 3)), "unshifted": some(C.array_unshift(x, F.lit(8.0))), "reversed_": some(F.reverse(x))}
    return rows.select("vec_id", *[r6(c).alias(k) for k, c in made.items()], *[c.alias(k) for k, c in texts.items()], F.array_contains(x, 1.0).alias("has_one"), C.some(x).alias("any_"))


_TEXT = lambda x: f"array_to_string([x::BIGINT::VARCHAR for x in ({x})[1:6]], ',')"
register(
    "array_edits",
    array_edits,
    f"""WITH e AS (SELECT vec_id, [floor(x::DOUBLE * 4) for x in embedding] AS b FROM embeddings), f AS (SELECT *, len(b) AS n, list_sort(b) AS s FROM e)
    SELECT vec_id, {rd("list_sort([{'n': -len([y for y in b if y = x]), 'i': list_position(b, x), 'v': x} for x in list_distinct(b)])[1].v")} AS mode_, {rd('list_position(b, b[1]) - 1')} AS at_first, {rd('n - list_position(list_reverse(b), b[1])')} AS at_last, {rd('len([x for x in b if x < b[4]])')} AS from_left, {rd('len([x for x in b if x <= b[4]])')} AS from_right, {rd('b[n - 1]')} AS popped, {rd('6')} AS pushed, {rd('list_sum([abs(x) for x in b])')} AS total_abs, {rd('4.5')} AS new_sum, {rd('s[n]')} AS largest, {rd('2 * n')} AS joined_size, {rd('b[n]')} AS last_,
    {_TEXT('b[1:2] || [9.0] || b[4:]')} AS set_, {_TEXT('b[1:1] || [7.0] || b[2:]')} AS inserted, {_TEXT('b[2:]')} AS shifted, {_TEXT('b[1:2] || b[4:]')} AS removed, {_TEXT('b[1:1] || [5.0, 5.0] || b[4:]')} AS filled, {_TEXT('[8.0] || b')} AS unshifted, {_TEXT('list_reverse(b)')} AS reversed_, list_contains(b, 1.0) AS has_one, len([x for x in b if x <> 0]) > 0 AS any_ FROM f""",
)


def matrix_edits(spark, sf_dir):
    e = lambda i: F.floor(F.get(F.col("embedding"), F.lit(i)).cast("double") * 4).cast("double")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.array(*[F.array(*[e(3 * i + j) for j in range(3)]) for i in range(3)]).alias("m"))
    m = F.col("m")
    at = lambda x, i, j: F.get(F.get(x, F.lit(i)), F.lit(j))
    rows = rows.withColumn("d", C.det("m")).withColumn("inv", C.inverse("m")).withColumn("cube", C.matrix_power("m", 3))
    ones, unit = C.matrix_new(2, 2, F.lit(1.0)), F.array(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0)))
    made = {
        "row_sum": C.array_sum(C.matrix_row(m, 1)), "col_sum": C.array_sum(C.matrix_col(m, 2)), "set_sum": C.array_sum(C.cells(C.matrix_set(m, 1, 1, F.lit(50.0)))), "added_row": C.array_sum(C.cells(C.matrix_add_row(m, C.matrix_row(m, 0), 1))), "added_col": at(C.matrix_add_col(m, C.matrix_row(m, 2), 1), 0, 1), "less_row": C.array_sum(C.cells(C.matrix_without_row(m, 0))), "less_col": C.array_sum(C.cells(C.matrix_without_col(m, 1))), "swapped": at(C.matrix_swap_rows(m, 0, 2), 0, 1), "swapped_col": at(C.matrix_swap_columns(m, 0, 2), 1, 0),
        "sub_trace": C.trace(C.submatrix(m, 0, 2, 1, 3)), "flat": at(C.reshape(m, 1, 9), 0, 7), "taller": F.size(C.matrix_concat(m, m)).cast("double"), "wider": at(C.matrix_concat(m, m, True), 2, 5), "sorted_": at(C.matrix_sort(m, 0), 0, 0), "sorted_down": at(C.matrix_sort(m, 1, True), 0, 1), "total": C.array_sum(C.cells(m)), "mean": C.array_avg(C.cells(m)), "least_": C.array_nth(C.cells(m), 0, False), "most_": C.array_nth(C.cells(m), 0), "median_": C.array_median(C.cells(m)), "mode_": C.matrix_mode(m),
        "plus_": at(C.matrix_plus(m, C.transpose(m)), 0, 2), "less": at(C.matrix_plus(m, 2.0, -1), 1, 2), "product": at(C.mult(m, m), 1, 2), "det_": F.col("d"), "inverse_": at(F.col("inv"), 0, 0), "cube_": at(F.col("cube"), 0, 1), "kron_": at(C.kron(ones, m), 4, 5),
    }
    tests = {"symmetric": C.matrix_tests["is_symmetric"](C.matrix_plus(m, C.transpose(m))), "symmetric_own": C.matrix_tests["is_symmetric"](m), "antisymmetric": C.matrix_tests["is_antisymmetric"](C.matrix_plus(m, C.transpose(m), -1)), "diagonal": C.matrix_tests["is_diagonal"](m), "antidiagonal": C.matrix_tests["is_antidiagonal"](m), "identity": C.matrix_tests["is_identity"](unit), "triangular": C.matrix_tests["is_triangular"](m), "stochastic": C.matrix_tests["is_stochastic"](unit), "binary_": C.matrix_tests["is_binary"](m), "zero": C.matrix_tests["is_zero"](C.matrix_plus(m, m, -1)), "square": C.matrix_tests["is_square"](C.submatrix(m, 0, 2))}
    return rows.select("vec_id", *[r6(c).alias(k) for k, c in made.items()], *[c.alias(k) for k, c in tests.items()])


register(
    "matrix_edits",
    matrix_edits,
    f"""WITH e AS (SELECT vec_id, [floor(x::DOUBLE * 4) for x in embedding[1:9]] AS b FROM embeddings), f AS (SELECT vec_id, b, {', '.join(f'b[{i + 1}] AS e{i}' for i in range(9))}, list_sum(b) AS t, list_sort(b) AS s FROM e), g AS (SELECT *, e0 * (e4 * e8 - e5 * e7) - e1 * (e3 * e8 - e5 * e6) + e2 * (e3 * e7 - e4 * e6) AS d FROM f)
    SELECT vec_id, {rd('e3 + e4 + e5')} AS row_sum, {rd('e2 + e5 + e8')} AS col_sum, {rd('t - e4 + 50')} AS set_sum, {rd('t + e0 + e1 + e2')} AS added_row, {rd('e6')} AS added_col, {rd('t - e0 - e1 - e2')} AS less_row, {rd('t - e1 - e4 - e7')} AS less_col, {rd('e7')} AS swapped, {rd('e5')} AS swapped_col, {rd('e1 + e5')} AS sub_trace, {rd('e7')} AS flat, {rd('6')} AS taller, {rd('e8')} AS wider, {rd('least(e0, e3, e6)')} AS sorted_, {rd('greatest(e1, e4, e7)')} AS sorted_down, {rd('t')} AS total, {rd('t / 9')} AS mean, {rd('s[1]')} AS least_, {rd('s[9]')} AS most_, {rd('s[5]')} AS median_,
    {rd("list_sort([{'n': -len([y for y in b if y = x]), 'v': x} for x in list_distinct(b)])[1].v")} AS mode_, {rd('e2 + e6')} AS plus_, {rd('e5 - 2')} AS less, {rd('e3 * e2 + e4 * e5 + e5 * e8')} AS product, {rd('d')} AS det_, {rd('(e4 * e8 - e5 * e7) / nullif(d, 0)')} AS inverse_, {rd('e0 * (e0 * e1 + e1 * e4 + e2 * e7) + e1 * (e3 * e1 + e4 * e4 + e5 * e7) + e2 * (e6 * e1 + e7 * e4 + e8 * e7)')} AS cube_, {rd('e5')} AS kron_,
    TRUE AS symmetric, e1 = e3 AND e2 = e6 AND e5 = e7 AS symmetric_own, TRUE AS antisymmetric, e1 = 0 AND e2 = 0 AND e3 = 0 AND e5 = 0 AND e6 = 0 AND e7 = 0 AS diagonal, e0 = 0 AND e1 = 0 AND e3 = 0 AND e5 = 0 AND e7 = 0 AND e8 = 0 AS antidiagonal, TRUE AS identity, (e1 = 0 AND e2 = 0 AND e5 = 0) OR (e3 = 0 AND e6 = 0 AND e7 = 0) AS triangular, TRUE AS stochastic, len([x for x in b if x not in (0, 1)]) = 0 AS binary_, TRUE AS zero, FALSE AS square FROM g""",
)


def map_edits(spark, sf_dir):
    m = F.create_map(F.col("o_orderpriority"), F.col("o_totalprice"), F.lit("k"), F.lit(1.0))
    other = F.create_map(F.lit("k"), F.lit(2.0), F.col("o_orderstatus"), F.lit(3.0))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", m.alias("m"), other.alias("o"), "o_orderpriority", "o_orderstatus", "o_totalprice")
    both = C.map_put_all("m", "o")
    return rows.select("o_orderkey", C.map_size(both).cast("long").alias("p_size"), r6(C.map_get(both, F.lit("k"))).alias("p_k"), r6(C.map_get(both, "o_orderpriority")).alias("p_own"), F.array_join(C.map_keys(both), ",").alias("p_keys"), r6(C.array_sum(C.map_values(C.map_remove(both, "o_orderstatus")))).alias("p_sum"))


register("map_edits", map_edits, f"SELECT o_orderkey, 3::BIGINT AS p_size, {rd('2')} AS p_k, {rd('o_totalprice')} AS p_own, o_orderpriority || ',k,' || o_orderstatus AS p_keys, {rd('o_totalprice + 2')} AS p_sum FROM orders")

# -- backtests --------------------------------------------------------------------------------------

TRADED = {"entry_id": None, "exit_id": None, "exit_comment": None, "entry_bar_index": "long", "exit_bar_index": "long", "size": "double", "entry_price": "double", "exit_price": "double", "profit": "double"}


def traded(bars: DataFrame, source: str, *more: str) -> DataFrame:
    out = script.trades(bars, source)
    return out.select("symbol", "trade", *[(r6(F.col(c)) if k == "double" else F.col(c)).alias(c) for c, k in TRADED.items()], *[r6(F.col(c)).alias(c) for c in more])


def traded_sql(rows: str, **shown: str) -> str:
    """A ledger in the order of exits; shown are SQL of TRADED's columns over rows."""
    return "SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY exit_bar_index, entry_bar_index) - 1 AS trade, * EXCLUDE (symbol) FROM (SELECT symbol, " + ", ".join(f"{rd(v)} AS {c}" if TRADED.get(c, "double") == "double" else f"({v})::BIGINT AS {c}" if TRADED[c] == "long" else f"{v} AS {c}" for c, v in shown.items()) + f" FROM {rows})"


TURN = """//@version=5
strategy("Turn", initial_capital=10000)
if bar_index % 12 == 0
    strategy.entry("L", strategy.long, qty=2, comment="up")
if bar_index % 12 == 6
    strategy.entry("S", strategy.short, qty=2)
"""


def strategy_reversals(spark, sf_dir):
    return traded(hourly(spark, sf_dir), TURN, "profit_percent", "max_runup", "max_drawdown")


register(
    "strategy_reversals",
    strategy_reversals,
    f"""WITH {BARS}, ev AS (SELECT symbol, bar_index, open, CASE WHEN bar_index % 12 = 1 THEN 1 ELSE -1 END AS way FROM bars WHERE bar_index % 12 IN (1, 7)),
    tr AS (SELECT *, lead(bar_index) OVER w AS until, lead(open) OVER w AS price FROM ev WINDOW w AS (PARTITION BY symbol ORDER BY bar_index)),
    x AS (SELECT tr.symbol, tr.bar_index, tr.open, way, until, price, max(b.high) AS hi, min(b.low) AS lo FROM tr JOIN bars b ON b.symbol = tr.symbol AND b.bar_index > tr.bar_index AND b.bar_index <= until WHERE until IS NOT NULL GROUP BY ALL)
    """
    + traded_sql("x", entry_id="CASE WHEN way = 1 THEN 'L' ELSE 'S' END", exit_id="CASE WHEN way = 1 THEN 'S' ELSE 'L' END", exit_comment="CASE WHEN way = 1 THEN '' ELSE 'up' END", entry_bar_index="bar_index", exit_bar_index="until", size="2 * way", entry_price="open", exit_price="price", profit="2 * way * (price - open)", profit_percent="way * (price - open) / open * 100", max_runup="greatest(0, 2 * CASE WHEN way = 1 THEN hi - open ELSE open - lo END)", max_drawdown="greatest(0, 2 * CASE WHEN way = 1 THEN open - lo ELSE hi - open END)"),
)

PYRAMID = """//@version=5
strategy("Pyramid", initial_capital=10000, default_qty_value=2, pyramiding=3)
if bar_index % 20 < 4
    strategy.entry("L", strategy.long)
if bar_index % 20 == 7
    strategy.close("L", qty=2)
if bar_index % 20 == 10
    strategy.close_all(comment="done")
"""


def strategy_pyramid(spark, sf_dir):
    return traded(hourly(spark, sf_dir), PYRAMID)


register(
    "strategy_pyramid",
    strategy_pyramid,
    f"""WITH {BARS}, g AS (SELECT symbol, bar_index // 20 AS k, {', '.join(f'max(CASE WHEN bar_index % 20 = {i} THEN open END) AS o{i}' for i in (1, 2, 3, 8, 11))} FROM bars GROUP BY 1, 2),
    x AS (SELECT symbol, k, (o1 + o2 + o3) / 3 AS px, o8 AS price, 2 AS size, 'L' AS by_, '' AS said, 8 AS spot FROM g WHERE o8 IS NOT NULL UNION ALL SELECT symbol, k, (o1 + o2 + o3) / 3, o11, 4, '', 'done', 11 FROM g WHERE o11 IS NOT NULL)
    """
    + traded_sql("x", entry_id="'L'", exit_id="by_", exit_comment="said", entry_bar_index="20 * k + 1", exit_bar_index="20 * k + spot", size="size", entry_price="px", exit_price="price", profit="size * (price - px)"),
)

LEVELS = """//@version=5
strategy("Levels", initial_capital=10000)
if bar_index % 10 == 0
    strategy.entry("L", strategy.long, qty=1, limit=close - 20)
if bar_index % 10 == 5
    strategy.cancel("L")
strategy.exit("X", "L", profit=30, loss=25, comment_profit="won", comment_loss="lost")
if bar_index % 10 == 8
    strategy.close_all()
"""


def strategy_levels(spark, sf_dir):
    return traded(hourly(spark, sf_dir), LEVELS)


register(
    "strategy_levels",
    strategy_levels,
    f"""WITH {BARS}, o AS (SELECT symbol, bar_index // 10 AS k, close - 20 AS lim FROM bars WHERE bar_index % 10 = 0),
    f AS (SELECT o.symbol, k, lim, min(b.bar_index) AS e FROM o JOIN bars b ON b.symbol = o.symbol AND b.bar_index // 10 = k AND b.bar_index % 10 BETWEEN 1 AND 5 AND b.low <= lim GROUP BY ALL),
    g AS (SELECT f.symbol, k, e, least(b.open, lim) AS px FROM f JOIN bars b ON b.symbol = f.symbol AND b.bar_index = e),
    h AS (SELECT g.symbol, k, e, px, min(b.bar_index) AS x FROM g LEFT JOIN bars b ON b.symbol = g.symbol AND b.bar_index > e AND b.bar_index // 10 = k AND b.bar_index % 10 <= 8 AND (b.low <= px - 25 OR b.high >= px + 30) GROUP BY ALL),
    u AS (SELECT h.symbol, e, px, x IS NOT NULL AS hit, b.bar_index AS until, open, high, low FROM h JOIN bars b ON b.symbol = h.symbol AND b.bar_index = coalesce(x, 10 * k + 9)),
    v AS (SELECT *, CASE WHEN NOT hit THEN open WHEN open <= px - 25 OR open >= px + 30 THEN open WHEN low <= px - 25 THEN px - 25 ELSE px + 30 END AS price, CASE WHEN NOT hit THEN '' WHEN open <= px - 25 OR open < px + 30 AND low <= px - 25 THEN 'lost' ELSE 'won' END AS said FROM u)
    """
    + traded_sql("v", entry_id="'L'", exit_id="CASE WHEN hit THEN 'X' ELSE '' END", exit_comment="said", entry_bar_index="e", exit_bar_index="until", size="1", entry_price="px", exit_price="price", profit="price - px"),
)

#: name -> (script, condition and price of an entry given the order's close c, way, place in ten bars and price of the close)
STOPS = {
    "stop": ('strategy.entry("A", strategy.short, qty=1, stop=close - 15)', "strategy.cancel_all()", 'strategy.close("A", immediately=true)', "low <= c - 15", "least(open, c - 15)", -1, 8, "close"),
    "stop_limit": ('strategy.entry("A", strategy.long, qty=1, stop=close + 10, limit=close + 25)', 'strategy.cancel("A")', 'strategy.close("A")', "(open BETWEEN c + 10 AND c + 25) OR (high >= c + 10 AND low <= c + 25)", "CASE WHEN open BETWEEN c + 10 AND c + 25 THEN open ELSE c + 25 END", 1, 9, "open"),
    "short_limit": ('strategy.entry("A", strategy.short, qty=1, limit=close + 20)', "strategy.cancel_all()", 'strategy.close("A", qty_percent=100)', "high >= c + 20", "greatest(open, c + 20)", -1, 9, "open"),
    "order": ('strategy.order("A", strategy.long, qty=1, stop=close + 5)', "strategy.cancel_all()", 'strategy.close("A")', "high >= c + 5", "greatest(open, c + 5)", 1, 9, "open"),
}


def strategy_stops(spark, sf_dir):
    bars, out = hourly(spark, sf_dir), None
    for name, (enter, cancel, leave, *_) in STOPS.items():
        text = f'//@version=5\nstrategy("{name}", initial_capital=10000)\nif bar_index % 10 == 0\n    {enter}\nif bar_index % 10 == 4\n    {cancel}\nif bar_index % 10 == 8\n    {leave}\n'
        one = traded(bars, text).withColumn("kind", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


register(
    "strategy_stops",
    strategy_stops,
    f"WITH {BARS}, o AS (SELECT symbol, bar_index // 10 AS k, close AS c FROM bars WHERE bar_index % 10 = 0), q AS (SELECT b.*, k, c FROM o JOIN bars b ON b.symbol = o.symbol AND b.bar_index // 10 = k AND b.bar_index % 10 BETWEEN 1 AND 4) "
    + " UNION ALL ".join(
        f"SELECT *, '{name}' AS kind FROM (" + traded_sql(f"(SELECT f.symbol, e, px, z.bar_index AS until, z.{price} AS price FROM (SELECT symbol, k, min(bar_index) AS e, arg_min({at}, bar_index) AS px FROM q WHERE {when} GROUP BY 1, 2) f JOIN bars z ON z.symbol = f.symbol AND z.bar_index = 10 * k + {place})", entry_id="'A'", exit_id="'A'", exit_comment="''", entry_bar_index="e", exit_bar_index="until", size=str(way), entry_price="px", exit_price="price", profit=f"{way} * (price - px)") + ")"
        for name, (_, _, _, when, at, way, place, price) in STOPS.items()
    ),
)

TRAIL = """//@version=5
strategy("Trail", initial_capital=10000)
if bar_index % 20 == 0
    strategy.entry("L", strategy.long, qty=1)
strategy.exit("T", "L", trail_points=20, trail_offset=15, comment_trailing="trail")
if bar_index % 20 == 15
    strategy.close_all()
"""


def strategy_trailing(spark, sf_dir):
    return traded(hourly(spark, sf_dir), TRAIL)


register(
    "strategy_trailing",
    strategy_trailing,
    f"""WITH {BARS}, e AS (SELECT symbol, bar_index // 20 AS k, open AS px FROM bars WHERE bar_index % 20 = 1),
    q AS (SELECT b.*, k, px, max(high) OVER (PARTITION BY b.symbol, k ORDER BY b.bar_index) AS top FROM e JOIN bars b ON b.symbol = e.symbol AND b.bar_index // 20 = k AND b.bar_index % 20 BETWEEN 2 AND 15),
    r AS (SELECT *, CASE WHEN top >= px + 20 THEN top - 15 END AS line_ FROM q), s AS (SELECT *, lag(line_) OVER (PARTITION BY symbol, k ORDER BY bar_index) AS before FROM r),
    h AS (SELECT symbol, k, min(bar_index) AS x, arg_min(CASE WHEN open <= before THEN open ELSE line_ END, bar_index) AS price FROM s WHERE coalesce(open <= before, FALSE) OR low <= line_ GROUP BY 1, 2),
    u AS (SELECT e.symbol, e.k, px, x, coalesce(x, z.bar_index) AS until, CASE WHEN x IS NULL THEN z.open ELSE price END AS out_ FROM e LEFT JOIN h ON h.symbol = e.symbol AND h.k = e.k LEFT JOIN bars z ON z.symbol = e.symbol AND z.bar_index = 20 * e.k + 16), v AS (SELECT * FROM u WHERE until IS NOT NULL)
    """
    + traded_sql("v", entry_id="'L'", exit_id="CASE WHEN x IS NULL THEN '' ELSE 'T' END", exit_comment="CASE WHEN x IS NULL THEN '' ELSE 'trail' END", entry_bar_index="20 * k + 1", exit_bar_index="until", size="1", entry_price="px", exit_price="out_", profit="out_ - px"),
)

RISKS = {
    "direction": ("strategy.risk.allow_entry_in(strategy.direction.long)\nstrategy.risk.max_position_size(1.5)", 12, 6, "TRUE", 1.5),
    "fills": ("strategy.risk.allow_entry_in(strategy.direction.long)\nstrategy.risk.max_intraday_filled_orders(1)", 6, 3, "row_number() OVER (PARTITION BY symbol, time_ms // 86400000 ORDER BY bar_index) = 1", 2.0),
}


def strategy_risks(spark, sf_dir):
    bars, out = hourly(spark, sf_dir), None
    for name, (rules, every, later, _, _) in RISKS.items():
        text = f'//@version=5\nstrategy("{name}", initial_capital=10000)\n{rules}\nif bar_index % {every} == 0\n    strategy.entry("L", strategy.long, qty=2)\nif bar_index % {every} == {later}\n    strategy.entry("S", strategy.short, qty=2)\n'
        one = traded(bars, text).withColumn("kind", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


register(
    "strategy_risks",
    strategy_risks,
    f"WITH {BARS} "
    + " UNION ALL ".join(
        f"SELECT *, '{name}' AS kind FROM (" + traded_sql(f"(SELECT e.symbol, e.bar_index AS e, e.open AS px, z.bar_index AS until, z.open AS price FROM (SELECT *, {when} AS on_ FROM bars WHERE bar_index % {every} = 1) e JOIN bars z ON z.symbol = e.symbol AND z.bar_index = e.bar_index + {later} WHERE on_)", entry_id="'L'", exit_id="'S'", exit_comment="''", entry_bar_index="e", exit_bar_index="until", size=str(size), entry_price="px", exit_price="price", profit=f"{size} * (price - px)") + ")"
        for name, (_, every, later, when, size) in RISKS.items()
    ),
)

SHARE = """//@version=5
strategy("Share", initial_capital=10000, default_qty_type=strategy.percent_of_equity, default_qty_value=0.1)
if bar_index % 8 == 0
    strategy.entry("L", strategy.long, comment="in")
if bar_index % 8 == 4
    strategy.close("L")
n = strategy.closedtrades
plot(n, "closed")
plot(n > 0 ? strategy.closedtrades.entry_price(n - 1) : na, "entry")
plot(n > 0 ? strategy.closedtrades.exit_bar_index(n - 1) : na, "exit_bar")
plot(n > 0 ? strategy.closedtrades.profit(n - 1) : na, "profit")
plot(n > 0 and strategy.closedtrades.entry_id(n - 1) == "L" ? 1 : 0, "named")
plot(strategy.opentrades, "open")
plot(strategy.opentrades.entry_price(0), "open_price")
plot(strategy.opentrades.size(0), "open_size")
plot(strategy.opentrades.profit(0), "open_profit")
plot(strategy.position_size, "size")
plot(strategy.position_avg_price, "average")
plot(strategy.equity, "equity")
plot(strategy.netprofit, "net")
plot(strategy.openprofit, "floating")
plot(strategy.wintrades + strategy.losstrades + strategy.eventrades, "all")
plot(strategy.convert_to_account(close), "converted")
"""
#: name -> SQL; sizes are a share of what was won before, so that values are compared to three decimals.
_SHARED = {
    "closed": "k + CASE WHEN r >= 5 THEN 1 ELSE 0 END", "entry_": "CASE WHEN r >= 5 THEN o1 ELSE o1_before END", "exit_bar": "CASE WHEN r >= 5 THEN 8 * k + 5 WHEN k > 0 THEN 8 * k - 3 END", "profit": "CASE WHEN r >= 5 THEN eq * (f - 1) WHEN k > 0 THEN eq - eq / f_before END", "named": "CASE WHEN r >= 5 OR k > 0 THEN 1 ELSE 0 END", "open_": "held", "open_price": "CASE WHEN held = 1 THEN o1 END", "open_size": "CASE WHEN held = 1 THEN eq / 1000 / o1 END", "open_profit": "CASE WHEN held = 1 THEN eq / 1000 / o1 * (close - o1) END", "size_": "held * coalesce(eq / 1000 / o1, 0)", "average": "CASE WHEN held = 1 THEN o1 END",
    "equity": "CASE WHEN r >= 5 THEN eq * f ELSE eq END + held * coalesce(eq / 1000 / o1 * (close - o1), 0)", "net": "CASE WHEN r >= 5 THEN eq * f ELSE eq END - 10000", "floating": "held * coalesce(eq / 1000 / o1 * (close - o1), 0)", "all_": "k + CASE WHEN r >= 5 THEN 1 ELSE 0 END", "converted": "close",
}


def strategy_accessors(spark, sf_dir):
    out = script.plots(hourly(spark, sf_dir), SHARE)
    return out.select("symbol", "bar_index", *[rounded(F.col(f"plot_{i}"), 3).alias(c) for i, c in enumerate(_SHARED)])


register(
    "strategy_accessors",
    strategy_accessors,
    f"""WITH {BARS}, g AS (SELECT symbol, bar_index // 8 AS k, max(CASE WHEN bar_index % 8 = 1 THEN open END) AS o1, max(CASE WHEN bar_index % 8 = 5 THEN open END) AS o5 FROM bars GROUP BY 1, 2),
    h AS (SELECT *, 1 + 0.001 * (o5 / o1 - 1) AS f FROM g), i AS (SELECT *, lag(f) OVER w AS f_before, lag(o1) OVER w AS o1_before, 10000 * coalesce(product(f) OVER (PARTITION BY symbol ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS eq FROM h WINDOW w AS (PARTITION BY symbol ORDER BY k)),
    z AS (SELECT b.*, k, bar_index % 8 AS r, o1, f, f_before, o1_before, eq, CASE WHEN bar_index % 8 BETWEEN 1 AND 4 THEN 1 ELSE 0 END AS held FROM bars b JOIN i ON i.symbol = b.symbol AND k = bar_index // 8)
    SELECT symbol, bar_index::BIGINT AS bar_index, """
    + ", ".join(f"round(({v})::DOUBLE + {NUDGE!r}, 3) + 0.0 AS {c}" for c, v in _SHARED.items())
    + " FROM z",
)

# -- streams ----------------------------------------------------------------------------------------


def ticks(spark, sf_dir) -> DataFrame:
    """The events as a stream, file by file."""
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _streamed(spark, sf_dir) -> DataFrame:
    made = S.ticks_to_bars(ticks(spark, sf_dir).where("value is not null"), F.col("event_type"), F.col("ts"), F.col("value"), tie=F.col("event_id"))
    return S.drained(made, "bars")


def stream_bars(spark, sf_dir):
    """Bars of the windows that are closed when the stream has been read: those an hour or more before its last tick."""
    return _streamed(spark, sf_dir).select("symbol", F.unix_millis("time").alias("time_ms"), *B.PRICES)


_CLOSED = BARS.replace("value IS NOT NULL GROUP BY 1, 2))", "value IS NOT NULL GROUP BY 1, 2) WHERE time + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events WHERE value IS NOT NULL))")
register("stream_bars", stream_bars, f"WITH {_CLOSED} SELECT symbol, time_ms, open, high, low, close, volume FROM bars")


def stream_series(spark, sf_dir):
    """Smoothings over streamed bars, with a state per symbol."""
    bars = _streamed(spark, sf_dir)
    out = S.running(spark.readStream.schema(S.SERIES).parquet(bars.inputFiles()[0].rsplit("/", 1)[0]), scan.op("ema", 9), scan.op("rma", 4, of="high"))
    return S.drained(out, "series").select("symbol", F.unix_millis("time").alias("time_ms"), r6(F.col("ema")).alias("ema"), r6(F.col("rma")).alias("rma"))


register("stream_series", stream_series, f"WITH RECURSIVE {_CLOSED}, " + smooth("a", "bars", {"ema": ema_("close", 9), "rma": Q.rma_("high", 4)}) + f" SELECT symbol, time_ms, {rd('ema')} AS ema, {rd('rma')} AS rma FROM a")


def stream_sessions(spark, sf_dir):
    """Runs of a type's ticks without a pause of 30 minutes."""
    made = S.sessions(ticks(spark, sf_dir).where("value is not null"), F.col("event_type"), F.col("ts"), F.col("value"))
    return S.drained(made, "sessions").select("symbol", F.unix_micros("start").alias("start"), F.unix_micros("until").alias("until"), "ticks", "low", "high")


register(
    "stream_sessions",
    stream_sessions,
    """WITH e AS (SELECT event_type AS symbol, ts, value FROM events WHERE ts IS NOT NULL AND value IS NOT NULL), a AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new_ FROM e WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
    b AS (SELECT *, sum(new_) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM a), c AS (SELECT symbol, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS until, count(*) AS ticks, min(value) AS low, max(value) AS high FROM b GROUP BY symbol, g)
    SELECT symbol, epoch_us(start) AS start, epoch_us(until) AS until, ticks::BIGINT AS ticks, low, high FROM c WHERE until + INTERVAL 1 HOUR <= (SELECT max(ts) FROM e)""",
)
