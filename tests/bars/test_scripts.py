"""The script front end, the interpreter, backtests, higher timeframes and streams."""

import math

import pytest
from pyspark.sql import functions as F

from tidewell.functions import library as lib
from tidewell.operators import htf
from tidewell.operators.broker import Broker
from tidewell.plans import interpreter, lower, script
from tidewell.plans.syntax import SyntaxProblem, parse
from tidewell.sources import bars as B

OPEN = [49, 50, 54, 51, 57, 53, 58, 62, 58, 65]
CLOSE = [50, 53, 51, 56, 54, 58, 61, 59, 64, 62]
DATA = {"open": OPEN, "high": [max(x) + 1 for x in zip(OPEN, CLOSE, strict=True)], "low": [min(x) - 2 for x in zip(OPEN, CLOSE, strict=True)], "close": CLOSE, "volume": [10 * i % 37 + 5 for i in range(10)]}


def values(body, name="x", data=DATA, **options):
    p = interpreter.run(f'//@version=5\nindicator("t")\n{body}', data, **options)
    return [None if v is None or v != v else v for v in (s[name] for s in p.snapshots)]


def test_var_history_and_na():
    assert values("var int x = 0\nx := x + 1") == list(range(1, 11))
    assert values("var float x = na\nx := close[2]") == [None, None, *CLOSE[:-2]]
    assert values("var bool x = na\nx := na == na")[0] is True
    assert values("var float x = na\nx := 7 / 2 + 7.0 / 2")[0] == 6.5
    assert values("var float x = na\nx := close / 0")[0] is None


def test_control_flow():
    assert values("var int x = 0\nx := 0\nfor i = 1 to 4\n    if i == 3\n        continue\n    x += i")[0] == 7
    assert values("var int x = 0\nx := 0\nwhile x < 5\n    x += 2")[0] == 6
    assert values("var string x = na\nx := switch\n    close > 60 => 'up'\n    close < 51, close == 56 => 'low'\n    => 'mid'") == ["up" if c > 60 else "low" if c < 51 or c == 56 else "mid" for c in CLOSE]


def test_loops_end_and_the_script_goes_on():
    assert values("var int x = 0\nx := 0\nwhile true\n    x += 1")[:2] == [10_000, 10_000]
    assert values("var int x = 0\nvar int y = 0\ni = 0\nwhile i < 20000\n    i += 1\nx := i\nfor k = 1 to 20000\n    y := k")[0] == 10_000
    assert values("var int y = 0\nfor k = 1 to 20000\n    y := k", "y")[0] == 10_000
    assert values("var int x = 0\nx := 0\na = array.new<int>(10500, 2)\nfor v in a\n    x += v")[0] == 21_000
    with pytest.raises(interpreter.ScriptHalt):
        values("var int x = 0\nif bar_index == 3\n    runtime.error('no')")


def test_calls_that_a_condition_may_skip_do_not_compile():
    bad = ["else if close > 2 and ta.crossover(close, open)", "else if close > 2 or na(fixnan(close))", "else if close > 2 ? ta.rising(close, 2) : true", "else if close > 2 and math.sum(close, 2) > 1"]
    good = ["else if ta.crossover(close, open) and close > 2", "else if close > 2 and math.abs(close) > 1", "else if close > 2 and f()", "else\n    if close > 2 and ta.rising(close, 2)\n        x := 3\nif close > 9"]
    text = "f() =>\n    close > 1 and ta.rising(close, 2)\nx = 0\nif close > 1 and ta.rising(close, 2)\n    x := 1\n{}\n    x := 2\n"
    for line in bad:
        with pytest.raises(interpreter.ScriptProblem):
            interpreter.run(text.format(line), DATA)
    for line in good:
        interpreter.run(text.format(line), DATA)


def test_requests_run_only_what_they_rest_on():
    tree = parse("a = 1\nb = a + close\nvar c = array.new<float>()\nc.push(b)\nplot(b)\nd = ta.sma(close, 200)\nx = request.security('', '5', c.size() + b)\n")
    call = next(n for n in interpreter.parts(tree) if isinstance(n, tuple) and n[:1] == ("call",) and n[1][0] == "dot" and n[1][1][:2] == ("name", "request"))
    kept = interpreter.needed_for(tree, call)
    assert [s[3] if s[0] == "decl" else "push" for s in kept] == ["a", "b", "c", "push", "x"]
    body = "var float y = na\nn = close * 2\nvar float t = 0.0\nt += n\ny := request.security(syminfo.tickerid, '5', t)"
    assert values(body, "y") == [None] * 5 + [2.0 * CLOSE[4]] * 5


def test_functions_keep_state_per_place_of_call():
    body = "count() =>\n    var int n = 0\n    n += 1\n    n\nvar int x = 0\na = count()\nb = 0\nif bar_index % 2 == 0\n    b := count()\nx := a * 100 + b"
    assert values(body)[:4] == [101, 200, 302, 400]


def test_calls_in_branches_advance_when_taken_but_in_choices_always():
    assert values("var float x = na\nif bar_index % 2 == 0\n    x := ta.cum(close)")[:4] == [50, 50, 101, 101]
    assert values("var float x = na\nx := bar_index % 2 == 0 ? ta.cum(close) : 0")[:4] == [50, 0, 154, 0]


def test_records_enums_methods_and_collections():
    body = "type P\n    float a = 1.0\n    float b\nmethod add(P p, float d) =>\n    p.a := p.a + d\n    p.a\nenum E\n    one\n    two = 'second'\nvar p = P.new(b=3.0)\nvar float x = na\nvar string y = na\nx := p.add(0.5) + p.b\ny := E.two"
    assert values(body)[:2] == [4.5, 5.0] and values(body, "y")[0] == "second"
    body = "var float x = na\na = array.from(3.0, 1.0, 2.0)\na.sort()\nm = map.new<string, float>()\nm.put('k', a.get(2))\nq = matrix.new<float>(2, 2, 1.0)\nq.set(0, 1, 4.0)\nx := m.get('k') + q.det()"
    assert values(body)[0] == 0.0


def test_strings():
    assert lib.tostring(1.0) == "1.0" and lib.tostring(3) == "3" and lib.tostring(2.5, "#") == "3" and lib.tostring(math.nan) == "NaN"
    assert lib.format_text("{0} {1,number,#.##}", "a", 3.14159) == "a 3.14" and lib.format_text("{0}", None) is None
    assert lib.replace_nth("a-a-a", "a", "b", 2) == "a-b-a" and math.isnan(lib.tonumber("0x1"))


def test_matrices():
    m = lib.Matrix([[2.0, 1.0], [4.0, 3.0]])
    assert lib.det(m) == 2.0 and lib.mult(m, lib.inverse(m)) == [[1.0, 0.0], [0.0, 1.0]]
    assert lib.rank([[1.0, 2.0], [2.0, 4.0]]) == 1 and lib.inverse([[1.0, 2.0], [2.0, 4.0]]) is None
    assert lib.eigenvalues([[2.0, 0.0], [0.0, 5.0]]) == [5.0, 2.0] and lib.power(m, 0) == [[1.0, 0.0], [0.0, 1.0]]


def test_syntax_problems():
    with pytest.raises(SyntaxProblem):
        parse("x = (1")
    with pytest.raises(interpreter.ScriptProblem):
        interpreter.run("x = unknown_name", DATA)
    assert parse("a = 1 +\n  2\n")[0][0] == "decl"


SIXTHS = [1_709_251_200_000 + i * 21_600_000 for i in range(11)]  # four bars a day
HTF = {"open": [7, 9, 8, 6, 5, 8, 9, 12, 11, 10, 13], "high": [10, 11, 9, 8, 9, 10, 13, 14, 12, 14, 15], "low": [6, 7, 5, 4, 4, 7, 8, 10, 9, 9, 12], "close": [9, 8, 6, 5, 8, 9, 12, 11, 10, 13, 14], "volume": [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5], "time": SIXTHS}
DAYS = [range(0, 4), range(4, 8), range(8, 11)]


def test_higher_timeframe(spark):
    bars = B.from_arrays(spark, HTF)
    days = htf.higher(bars, "D").orderBy("bar_index").collect()
    at = lambda c, d: [HTF[c][i] for i in d]
    assert [(d.open, d.high, d.low, d.close, d.volume) for d in days] == [(at("open", d)[0], max(at("high", d)), min(at("low", d)), at("close", d)[-1], sum(at("volume", d))) for d in DAYS]
    ends = [HTF["close"][d[-1]] for d in DAYS]
    want = [None] * 4 + [ends[0]] * 4 + [ends[1]] * 3
    assert [r.c for r in htf.security(bars, "D", {"c": "close"}).orderBy("bar_index").collect()] == want
    assert [r.c for r in htf.security(bars, "D", {"c": "close"}, timed=True).orderBy("bar_index").collect()] == want
    assert values('var float x = na\nx := request.security(syminfo.tickerid, "D", close)', data=HTF) == want
    assert values('var float x = na\nx := request.security(syminfo.tickerid, "D", ta.cum(close), lookahead=barmerge.lookahead_on)', data=HTF)[-1] == sum(ends)


def test_broker():
    b = Broker(10_000)
    b.bar(0, math.nan, 10, 11, 9, 10)
    b.entry("L", "long", 2)
    b.bar(1, math.nan, 12, 13, 11, 12)
    b.exit("X", "L", stop=10.0, limit=15.0)
    b.bar(2, math.nan, 12, 16, 12, 14)
    assert b.size == 0 and [(t.entry_price, t.exit_price, t.profit) for t in b.trades] == [(12, 15.0, 6.0)]
    b.entry("S", "short", 1, stop=13.0)
    b.bar(3, math.nan, 14, 15, 12, 12)
    assert b.size == -1 and b.average == 13.0 and b.equity(12) == 10_007


STRATEGY = '//@version=5\nstrategy("s")\nif bar_index == 1\n    strategy.entry("L", strategy.long, qty=3)\nif bar_index == 5\n    strategy.close("L")\n'


def test_script_frames(spark):
    bars = B.from_arrays(spark, DATA, "a").unionByName(B.from_arrays(spark, HTF, "b"))
    out = script.run(bars, '//@version=5\nindicator("x")\nvar float v = na\nv := ta.sma(close, 2)\nplot(v, "v")').orderBy("symbol", "bar_index").collect()
    assert len(out) == 21 and out[1].plot_0 == 51.5 and out[0].plot_0 is None and out[1].vars["v"] == "51.5"
    trades = {r.symbol: (r.entry_price, r.exit_price, r.profit) for r in script.trades(bars, STRATEGY).collect()}
    assert trades == {"a": (54.0, 58.0, 12.0), "b": (8.0, 9.0, 3.0)}
    assert script.equity(bars, STRATEGY).where("bar_index = 9 and symbol = 'a'").first().equity == 100_012


def same(a, b):
    """Rows of doubles, nulls among them, within 1e-9."""
    key = lambda r: (r.symbol, r.bar_index)
    a, b = sorted(a.collect(), key=key), sorted(b.collect(), key=key)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for u, v in zip(x, y, strict=True):
            assert u == v or u is not None and v is not None and abs(u - v) < 1e-9, (x, y)


LOWERED = {
    "windows": "len = input.int(3, 'Length')\nplot(ta.sma(close, len))\nplot(ta.wma(close, 4)[1])\n[a, b, c] = ta.bb(close, 3, 2)\nplot(b - c)\nplot(ta.highest(3) - ta.lowest(2))\nplot(ta.stoch(close, high, low, 3))\nplot(ta.valuewhen(close > open, high, 1))\nplot(ta.barssince(close > open))\nplot(ta.highestbars(close, 3) / 2)\nplot(ta.tr)\nplot(ta.obv)\nplot(ta.percentrank(close, 4))\nplot(ta.pivothigh(2, 1))\nplot(ta.correlation(close, open, 4))\nplot(ta.cum(volume))\nplot(math.sum(volume, 3))",
    "numbers": "x = 7 / 2\ny = bar_index % 3\nplot(x + y / 2)\nplot(close / (close - 50))\nplot(math.max(close, 55, open) + math.min(1, 2))\nplot(math.round(close / 3, 1))\nplot(nz(close[3], -1) + nz(na, 2))\nplot(close > open and not (volume > 20) ? 1 : close < open or na(close[5]) ? 2 : 3)\nplot(-close + 2 * hl2 - math.abs(open - close))\nplot(int(close / 7) + math.floor(close / 4) + math.sign(open - close))\nplot(math.pow(close, 0.5) + math.sqrt(close) + math.log(close))\nplot(close == 53 ? 1.5 : na)",
    "states": "var int n = 0\nvar float last = 0.0\nvar int down = 10\nif close > close[1]\n    n += 2\n    last := close\nelse if volume > 12\n    down -= 1\nfloat top = 0.0\nif close > 55\n    top := high\nelse\n    top := low\nplot(n)\nplot(last[1])\nplot(down)\nplot(top)\nplot(fixnan(close > 55 ? close : na))",
    "functions": "twice(x) => x * 2\nstep(float x, int k = 1) =>\n    d = x - x[1]\n    d * k\nmean(x, n) => ta.sma(x, n)\nplot(twice(close))\nplot(step(close) + step(open, 3))\nplot(mean(close, 2) - mean(open, 4))\nk = switch bar_index % 3\n    0 => 1\n    1 => 5\n    => 9\nplot(k)\nv = if close > 55\n    1\nelse if close > 52\n    2\nplot(v)\nplotshape(ta.crossover(close, open))\nh = hline(3)\nbgcolor(color.red)",
    "partly unknown": "a = array.new<float>()\na.push(close)\nvar label l = na\nif bar_index == 3\n    l := label.new(bar_index, high)\nfor i = 0 to 3\n    a.push(i)\nplot(ta.sma(close, 2))",
}
BARRED = ["var int n = 0\nif close > open\n    n += 1\nif close < open\n    n := 0\nplot(n)", "x = 0.0\nx := nz(x[1]) + close\nplot(x)", "plot(ta.ema(close, 3))", "x = 0.0\nif close > open\n    x := ta.cum(close)\nplot(x)", "n = bar_index % 3 + 1\nplot(ta.sma(close, n))", "a = array.new<float>(1, close)\nplot(a.get(0))", "if close > 900\n    runtime.error('x')\nplot(close)"]


def with_holes():
    out = {k: list(v) for k, v in DATA.items()}
    out["close"][4] = out["high"][6] = None
    return out


@pytest.mark.parametrize("name", LOWERED)
def test_lowered_scripts_agree_with_the_interpreter(spark, name):
    bars = B.from_arrays(spark, DATA, "a").unionByName(B.from_arrays(spark, HTF, "b"))
    bars = bars.unionByName(B.from_arrays(spark, with_holes(), "c"))
    text = "//@version=5\nindicator('t')\n" + LOWERED[name]
    out = lower.lower(bars, text)
    assert out is not None and not any(x in out._jdf.queryExecution().toString() for x in ("Python", "Pandas", "Arrow"))
    same(out, script.plots(bars, text, lowered=False))


def test_scripts_that_stay_with_the_interpreter(spark):
    bars = B.from_arrays(spark, DATA, "a")
    for body in BARRED:
        text = "//@version=5\nindicator('t')\n" + body
        assert lower.lower(bars, text) is None
        same(script.plots(bars, text), script.plots(bars, text, lowered=False))
    last = {r.name: r.value for r in script.final(bars, "//@version=5\nindicator('t')\nvar int n = 0\nn += 1\nvar string s = 'a'").collect()}
    assert last == {"n": "10", "s": '"a"'}


def test_made_up_bars():
    made = B.walk(3)
    assert made["open"][0] == 100.0 and made["open"][1:] == made["close"][:-1] and all(lo <= min(o, c) <= max(o, c) <= hi for o, hi, lo, c in zip(*[made[k] for k in ("open", "high", "low", "close")], strict=True))
    seed = int(12345 * 1103515245.0 + 12345) & 0x7FFFFFFF
    assert made["close"][0] == 100.0 * (1 + (seed / 0x7FFFFFFF - 0.5) * 0.04)


def test_streams(spark, tmp_path):
    from tidewell.operators import scan
    from tidewell.streaming import bars as S

    ticks = spark.createDataFrame([("a", 3600 * i + 60, float(i)) for i in range(6)], "s string, t long, v double")
    ticks.select("s", F.timestamp_seconds("t").alias("t"), "v").write.parquet(str(tmp_path / "ticks"))
    stream = spark.readStream.schema("s string, t timestamp, v double").parquet(str(tmp_path / "ticks"))
    bars = S.ticks_to_bars(stream, F.col("s"), F.col("t"), F.col("v"), late="0 seconds")
    q = bars.writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "bars")).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    out = S.running(spark.readStream.schema(S.SERIES).parquet(str(tmp_path / "bars")), scan.op("ema", 2))
    q = out.writeStream.format("memory").queryName("ema_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    got = [(r.close, r.ema) for r in spark.sql("select * from ema_out order by time").collect()]
    assert [c for c, _ in got] == [0.0, 1.0, 2.0, 3.0, 4.0] and got[1][1] == 0.5 and abs(got[2][1] - 1.5) < 1e-12
