"""Series states against plain formulas, and the windowed study and the scan against the states."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.functions import kernels, series
from tidewell.operators import scan
from tidewell.operators.study import Study
from tidewell.sources import bars as B

NAN = math.nan
#: The bars and, below, the results of published examples that the states must give.
SAMPLE = {"open": [100, 101, 102, 101, 103, 104, 105, 104, 106, 107], "high": [102, 103, 104, 103, 105, 106, 107, 106, 108, 109], "low": [99, 100, 101, 100, 102, 103, 104, 103, 105, 106], "close": [101, 102, 103, 102, 104, 105, 106, 105, 107, 108], "volume": [1000, 1100, 1200, 1150, 1300, 1250, 1400, 1350, 1500, 1450]}


def same(a, b):
    na = lambda x: x is None or x != x
    return na(a) and na(b) or not na(a) and not na(b) and abs(float(a) - float(b)) <= 1e-7 + 1e-9 * abs(float(b))


def column(name):
    return [float(x) for x in SAMPLE[name]]


@pytest.mark.parametrize(
    "make,args,want",
    [
        (series.Cci, [3], [NAN, NAN, 100, -50, 100, 80, 100, -50, 100, 80]),
        (series.Cmo, [3], [NAN, NAN, NAN, 33.333333333, 50, 50, 100, 33.333333333, 50, 50]),
        (series.Cum, [], [101, 203, 306, 408, 512, 617, 723, 828, 935, 1043]),
        (series.Mode, [3], [NAN, NAN, 101, 102, 102, 102, 104, 105, 105, 105]),
        (series.Range, [3], [NAN, NAN, 2, 1, 2, 3, 2, 1, 2, 3]),
    ],
)
def test_known_values(make, args, want):
    state = make()
    assert all(same(state.step(x, *args), w) for x, w in zip(column("close"), want, strict=True))


@pytest.mark.parametrize("make,params,values", [(series.Ema, [9], 1), (series.Rma, [1], 1), (series.Rma, [300], 1), (series.Dema, [7], 1), (series.Macd, [5, 11, 4], 3), (series.Rsi, [6], 1), (series.Rsi, [1], 1)])
@pytest.mark.parametrize("holes", [0.0, 0.1])
def test_kernels_agree_with_the_states(make, params, values, holes):
    r = random.Random(12)
    xs = [NAN if r.random() < holes else r.choice([50.0, 51.5, r.uniform(40, 60)]) for _ in range(1000)]
    slow, fast, got = make(), make(), []
    want = [slow.step(x, *params) for x in xs]
    cuts = [0, 1, 2, 9, 10, 200, 264, 900, 1000]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        got += list(zip(*[x.tolist() for x in kernels.steps(fast, [np.array(xs[a:b]), *params], b - a, values)], strict=True))
    for w, g in zip(want, got, strict=True):
        assert all(same(u, v) for u, v in zip(w if values > 1 else [w], g, strict=True))
    # either can go on from the other
    assert same(slow.step(55.0, *params) if values == 1 else slow.step(55.0, *params)[0], fast.step(55.0, *params) if values == 1 else fast.step(55.0, *params)[0])


def test_freeze_and_poison():
    ema, sma, rsi = series.Ema(), series.Over(series.mean), series.Rsi()
    xs = [1.0, NAN, 3.0, 5.0, NAN, 7.0]
    assert [same(ema.step(x, 2), w) for x, w in zip(xs, [NAN, NAN, 2, 4, NAN, 6], strict=True)] == [True] * 6
    assert [same(sma.step(x, 2), w) for x, w in zip(xs, [NAN, NAN, NAN, 4, NAN, NAN], strict=True)] == [True] * 6
    # the seed falls on the n-th value: two changes divided by three
    assert [same(rsi.step(x, 3), w) for x, w in zip([1.0, 2.0, 1.5], [NAN, NAN, 100 - 100 / (1 + 1 / 0.5)], strict=True)] == [True] * 3


def bars(spark, holes):
    r = random.Random(7)
    rows = []
    for s in ("a", "b"):
        price = 50.0
        for i in range(60):
            o, price = price, price + r.choice([-1.0, -0.5, 0.0, 0.5, 1.0])
            row = [o, max(o, price) + 0.5, min(o, price) - 0.5, price, float(r.randint(1, 9))]
            if holes and r.random() < 0.12:
                row[r.randrange(5)] = float("nan")
            rows.append((s, i, *row))
    df = spark.createDataFrame(rows, "symbol string, i long, open double, high double, low double, close double, volume double")
    return B.from_table(df, F.col("symbol"), F.lit(None).cast("long"), F.col("i")).withColumn("time_ms", F.lit(0).cast("long"))


STEPS = {
    "sma": (lambda: series.Over(series.mean), ["close", 5], lambda s: s.sma("close", 5)),
    "wma": (lambda: series.Over(series.weighted_mean), ["close", 5], lambda s: s.wma("close", 5)),
    "alma": (lambda: series.Over(series.gaussian), ["close", 5], lambda s: s.alma("close", 5)),
    "hma": (series.Hma, ["close", 6], lambda s: s.hma("close", 6)),
    "swma": (series.Swma, ["close"], lambda s: s.swma("close")),
    "vwma": (series.Vwma, ["close", "volume", 4], lambda s: s.vwma("close", 4)),
    "linreg": (lambda: series.Over(series.regression), ["close", 5, 1], lambda s: s.linreg("close", 5, 1)),
    "variance": (lambda: series.Over(series.population_variance), ["close", 5], lambda s: s.variance("close", 5)),
    "dev": (lambda: series.Over(series.mean_deviation), ["close", 5], lambda s: s.dev("close", 5)),
    "bbw": (series.BandWidth, ["close", 5, 2.0], lambda s: s.bbw("close", 5, 2.0)),
    "cci": (series.Cci, ["close", 4], lambda s: s.cci("close", 4)),
    "cmo": (series.Cmo, ["close", 4], lambda s: s.cmo("close", 4)),
    "mfi": (series.Mfi, ["close", "volume", 4], lambda s: s.mfi("close", 4)),
    "change": (series.Change, ["close", 2], lambda s: s.change("close", 2)),
    "roc": (series.Roc, ["close", 2], lambda s: s.roc("close", 2)),
    "highest": (lambda: series.Over(max), ["high", 4], lambda s: s.highest("high", 4)),
    "lowestbars": (lambda: series.Over(lambda w: series.newest_extreme(w, False)), ["low", 4], lambda s: s.lowestbars("low", 4)),
    "range": (series.Range, ["close", 4], lambda s: s.range("close", 4)),
    "stoch": (series.Stoch, ["close", "high", "low", 4], lambda s: s.stoch("close", "high", "low", 4)),
    "wpr": (series.Wpr, ["high", "low", "close", 4], lambda s: s.wpr(4)),
    "median": (lambda: series.Over(series.middle), ["close", 4], lambda s: s.median("close", 4)),
    "mode": (series.Mode, ["volume", 5], lambda s: s.mode("volume", 5)),
    "nearest": (lambda: series.Over(series.nearest_rank), ["close", 5, 60], lambda s: s.percentile_nearest_rank("close", 5, 60)),
    "linear": (lambda: series.Over(series.linear_percentile), ["close", 5, 60], lambda s: s.percentile_linear_interpolation("close", 5, 60)),
    "percentrank": (series.PercentRank, ["close", 5], lambda s: s.percentrank("close", 5)),
    "correlation": (series.Correlation, ["close", "volume", 5], lambda s: s.correlation("close", "volume", 5)),
    "cog": (lambda: series.Over(series.gravity), ["close", 5], lambda s: s.cog("close", 5)),
    "rci": (lambda: series.Over(series.rank_correlation), ["close", 5], lambda s: s.rci("close", 5)),
    "pivothigh": (lambda: series.Pivot(True), ["high", 2, 1], lambda s: s.pivothigh("high", 2, 1)),
    "crossover": (lambda: series.Cross(1), ["close", "open"], lambda s: s.crossover("close", "open")),
    "rising": (lambda: series.Streak(1), ["close", 2], lambda s: s.rising("close", 2)),
    "tr": (series.TrueRange, ["high", "low", "close"], lambda s: s.tr()),
    "sum": (series.Sum, ["close", 4], lambda s: s.sum("close", 4)),
    "cum": (series.Cum, ["close"], lambda s: s.cum("close")),
    "max": (lambda: series.Extreme(True), ["close"], lambda s: s.max("close")),
    "obv": (lambda: series.Accumulated(series.obv_amount, series.zero), ["close", "volume"], lambda s: s.obv()),
    "accdist": (lambda: series.Accumulated(series.accdist_amount, series.accdist_amount), ["close", "high", "low", "volume"], lambda s: s.accdist()),
    "pvt": (lambda: series.Accumulated(series.pvt_amount, series.zero), ["close", "volume"], lambda s: s.pvt()),
    "wad": (lambda: series.Accumulated(series.wad_amount, series.zero), ["high", "low", "close"], lambda s: s.wad()),
    "fixnan": (series.FixNan, ["close"], lambda s: s.fixnan("close")),
}


@pytest.mark.parametrize("holes", [False, True])
def test_study_equals_states(spark, holes):
    s = Study(bars(spark, holes))
    out = s.result(**{"v_" + k: build(s).cast("double") for k, (_, _, build) in STEPS.items()}).orderBy("symbol", "bar_index").collect()
    wrong = {}
    for name, (make, args, _) in STEPS.items():
        state, symbol = None, None
        for row in out:
            if row["symbol"] != symbol:
                state, symbol = make(), row["symbol"]
            want = state.step(*[(NAN if row[a] is None else row[a]) if isinstance(a, str) else a for a in args])
            if not same(row["v_" + name], want):
                wrong.setdefault(name, []).append((row["bar_index"], row["v_" + name], want))
    assert not wrong


def test_scan_runs_symbols_apart(spark):
    df = bars(spark, True)
    out = scan.scan(df, scan.op("ema", 3), scan.op("macd", 2, 4, 3), scan.op("highest", "volume", of="close", to="top")).orderBy("symbol", "bar_index").collect()
    states, symbol = None, None
    for row in out:
        if row["symbol"] != symbol:
            states, symbol = (series.Ema(), series.Macd(), series.Over(max)), row["symbol"]
        x, v = (NAN if row[c] is None else row[c] for c in ("close", "volume"))
        assert same(row["ema"], states[0].step(x, 3))
        assert all(same(row[f"macd_{i}"], m) for i, m in enumerate(states[1].step(x, 2, 4, 3)))
        assert same(row["top"], states[2].step(x, v))
