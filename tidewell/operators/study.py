"""Series operators over bars as window expressions.

A ``Study`` holds a bars DataFrame and adds what its operators need to it.  Operators take
and give Columns; one that rests on another's windows holds that result as a column first.
All share one ordering per symbol, so a study is one shuffle and one sort.  na is NULL.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else F.lit(x) if isinstance(x, int | float) else x


def ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


class Study:
    def __init__(self, bars: DataFrame, symbol: str = "symbol", order: str = "bar_index"):
        self.df, self.symbol, self.order = bars, symbol, order
        self.own = bars.columns
        self.line = Window.partitionBy(symbol).orderBy(order)
        self.past = self.line.rowsBetween(Window.unboundedPreceding, 0)
        self._held = 0
        self._periods: dict[str, tuple[Column, list[str]]] = {}

    # -- plumbing --------------------------------------------------------------

    def hold(self, x: Column, name: str | None = None) -> Column:
        """The expression as a column of the study."""
        if name is None:
            self._held += 1
            name = f"__s{self._held}"
        self.df = self.df.withColumn(name, x)
        return F.col(name)

    def result(self, **named) -> DataFrame:
        """The bars with the named series, without what was held in between."""
        df = self.df.withColumns({k: col(v) for k, v in named.items()})
        return df.select(*self.own, *[k for k in named if k not in self.own])

    def last(self, n: int):
        return self.line.rowsBetween(-(n - 1), 0)

    def full(self, x: Column, n: int, value: Column, frame=None) -> Column:
        """value where the last n rows all have x: warm-up and poison."""
        return F.when(F.count(x).over(frame or self.last(n)) == n, value)

    def lag(self, x, n: int = 1) -> Column:
        return F.lag(col(x), n).over(self.line)

    def _of(self, x) -> Column:
        """As a plain column, so that windows over it are not nested."""
        return F.col(x) if isinstance(x, str) else self.hold(col(x))

    def window(self, x, n: int, frame=None) -> Column:
        """Held array of the last n values, oldest first; null unless full."""
        x = self._of(x)
        return self.hold(self.full(x, n, F.collect_list(x).over(frame or self.last(n)), frame))

    def _apart(self, valid: Column):
        """Ordering among the rows for which valid holds: operators that freeze on na see no others."""
        return Window.partitionBy(self.symbol, valid).orderBy(self.order)

    # -- averages --------------------------------------------------------------

    def sma(self, x, n: int) -> Column:
        x = self._of(x)
        return self.full(x, n, F.avg(x).over(self.last(n)))

    def _ramp(self, x: Column, n: int) -> Column:
        """Sum of the last n values weighted 1 .. n, from two frame sums."""
        i, w = F.col(self.order), self.last(n)
        return F.sum(x * i).over(w) - (i - n) * F.sum(x).over(w)

    def wma(self, x, n: int) -> Column:
        x = self._of(x)
        return self.full(x, n, self._ramp(x, n) / (n * (n + 1) / 2))

    def alma(self, x, n: int, offset: float = 0.85, sigma: float = 6.0) -> Column:
        m, s = offset * (n - 1), n / sigma
        k = [math.exp(-((i - m) ** 2) / (2 * s * s)) for i in range(n)]
        return self._dot(x, n, [v / sum(k) for v in k])

    def _dot(self, x, n: int, weights: list[float]) -> Column:
        """Weights, oldest first, with the last n values."""
        return F.aggregate(F.zip_with(self.window(x, n), F.array(*map(F.lit, weights)), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)

    def hma(self, x, n: int) -> Column:
        x = self._of(x)
        d = self.hold(2 * self.wma(x, max(1, n // 2)) - self.wma(x, n))
        k, by = max(1, int(math.sqrt(n))), self._apart(d.isNotNull())
        frame = by.rowsBetween(-(k - 1), 0)
        i = self.hold(F.row_number().over(by))
        return F.when(d.isNotNull(), self.full(d, k, (F.sum(d * i).over(frame) - (i - k) * F.sum(d).over(frame)) / (k * (k + 1) / 2), frame))

    def swma(self, x) -> Column:
        x = self._of(x)
        return (self.lag(x, 3) + 2 * self.lag(x, 2) + 2 * self.lag(x, 1) + x) / 6

    def vwma(self, x, n: int, volume="volume") -> Column:
        pv, v = self._of(col(x) * col(volume)), self._of(volume)
        return ratio(self.full(pv, n, F.sum(pv).over(self.last(n))), self.full(v, n, F.sum(v).over(self.last(n))))

    def ao(self) -> Column:
        mid = self._of((F.col("high") + F.col("low")) / 2)
        return self.sma(mid, 5) - self.sma(mid, 34)

    def linreg(self, x, n: int, offset: int = 0) -> Column:
        x = self._of(x)
        if n == 1:
            return x
        mean = F.avg(x).over(self.last(n))
        slope = (self._ramp(x, n) - (n + 1) / 2 * F.sum(x).over(self.last(n))) / (n * (n * n - 1) / 12)
        return self.full(x, n, mean + slope * ((n - 1) / 2 + offset))

    def sum(self, x, n: int) -> Column:
        return F.coalesce(F.sum(self._of(x)).over(self.last(n)), F.lit(0.0))

    # -- spread ----------------------------------------------------------------

    def variance(self, x, n: int) -> Column:
        x = self._of(x)
        return self.full(x, n, F.var_pop(x).over(self.last(n)))

    def stdev(self, x, n: int, biased: bool = True) -> Column:
        x = self._of(x)
        return self.full(x, n, (F.stddev_pop if biased else F.stddev_samp)(x).over(self.last(n)))

    @staticmethod
    def _deviation(w: Column) -> Column:
        """Mean absolute deviation of an array from its mean."""
        mean = F.aggregate(w, F.lit(0.0), lambda a, b: a + b) / F.size(w)
        return F.aggregate(F.transform(w, lambda v: F.abs(v - mean)), F.lit(0.0), lambda a, b: a + b) / F.size(w)

    def dev(self, x, n: int) -> Column:
        return self._deviation(self.window(x, n))

    def bb(self, x, n: int, mult: float) -> tuple[Column, Column, Column]:
        x = self._of(x)
        mid, d = self.hold(self.sma(x, n)), self.hold(self.stdev(x, n))
        return mid, mid + mult * d, mid - mult * d

    def bbw(self, x, n: int, mult: float) -> Column:
        mid, up, low = self.bb(x, n, mult)
        return ratio(up - low, mid) * 100

    def cci(self, x, n: int) -> Column:
        x = self._of(x)
        on = self.hold(self.full(x, n, F.lit(True)))
        on = self.hold(F.max(on).over(self.past))
        frame = self._apart(x.isNotNull()).rowsBetween(-(n - 1), 0)
        w = self.hold(F.when(on & x.isNotNull(), F.collect_list(x).over(frame)))
        mean = F.aggregate(w, F.lit(0.0), lambda a, b: a + b) / F.size(w)
        d = self.hold(self._deviation(w))
        return F.when(d == 0, F.lit(0.0)).otherwise((x - mean) / (0.015 * d))

    def correlation(self, x, y, n: int) -> Column:
        x, y = self._of(x), self._of(y)
        w = self.last(n)
        r = ratio(F.covar_pop(x, y).over(w), F.stddev_pop(x).over(w) * F.stddev_pop(y).over(w))
        return self.full(x, n, self.full(y, n, r))

    # -- moves -----------------------------------------------------------------

    def change(self, x, n: int = 1) -> Column:
        x = self._of(x)
        return x - self.lag(x, n)

    mom = change

    def roc(self, x, n: int) -> Column:
        x = self._of(x)
        return 100 * ratio(x - self.lag(x, n), self.lag(x, n))

    def cmo(self, x, n: int) -> Column:
        d = self.hold(self.change(x))
        frame = self._apart(d.isNotNull()).rowsBetween(-(n - 1), 0)
        up, down = F.sum(F.greatest(d, F.lit(0.0))).over(frame), F.sum(F.greatest(-d, F.lit(0.0))).over(frame)
        return F.when(d.isNotNull(), self.full(d, n, F.when(up + down == 0, F.lit(0.0)).otherwise(100 * ratio(up - down, up + down)), frame))

    def mfi(self, x, n: int, volume="volume") -> Column:
        x, v = self._of(x), self._of(volume)
        valid = x.isNotNull() & v.isNotNull()
        before = F.lag(x).over(self._apart(valid))
        flow = self.hold(F.when(valid, x * v * F.signum(x - before)))
        frame = self._apart(flow.isNotNull()).rowsBetween(-(n - 1), 0)
        up, down = F.sum(F.greatest(flow, F.lit(0.0))).over(frame), F.sum(F.greatest(-flow, F.lit(0.0))).over(frame)
        return F.when(flow.isNotNull(), self.full(flow, n, F.when(down == 0, F.lit(100.0)).otherwise(100 - 100 / (1 + ratio(up, down))), frame))

    def rising(self, x, n: int, way: int = 1) -> Column:
        x = self._of(x)
        i = F.col(self.order)
        broken = self.hold(F.when(~F.coalesce(way * (x - self.lag(x)) > 0, F.lit(False)), i))
        return i - F.max(broken).over(self.past) >= n

    def falling(self, x, n: int) -> Column:
        return self.rising(x, n, -1)

    def crossover(self, a, b) -> Column:
        a, b = self._of(a), self._of(b)
        return F.coalesce((self.lag(a) <= self.lag(b)) & (a > b), F.lit(False))

    def crossunder(self, a, b) -> Column:
        return self.crossover(b, a)

    def cross(self, a, b) -> Column:
        a, b = self._of(a), self._of(b)
        return self.crossover(a, b) | self.crossunder(a, b)

    def tr(self, handle_na: bool = True) -> Column:
        h, low, before = F.col("high"), F.col("low"), self.lag("close")
        first = h - low if handle_na else F.lit(None).cast("double")
        return F.when(before.isNull(), first).when(h.isNotNull() & low.isNotNull(), F.greatest(h - low, F.abs(h - before), F.abs(low - before)))

    # -- extremes and ranks ----------------------------------------------------

    def highest(self, x="high", n: int = 1) -> Column:
        x = self._of(x)
        return self.full(x, n, F.max(x).over(self.last(n)))

    def lowest(self, x="low", n: int = 1) -> Column:
        x = self._of(x)
        return self.full(x, n, F.min(x).over(self.last(n)))

    def _bars_to(self, x: Column, n: int) -> Column:
        x, i = self._of(x), F.col(self.order)
        return self.full(x, n, F.max_by(i, F.struct(x, i)).over(self.last(n)) - i)

    def highestbars(self, x="high", n: int = 1) -> Column:
        return self._bars_to(col(x), n)

    def lowestbars(self, x="low", n: int = 1) -> Column:
        return self._bars_to(-col(x), n)

    def range(self, x, n: int) -> Column:
        x = self._of(x)
        return self.highest(x, n) - self.lowest(x, n)

    def stoch(self, x, high, low, n: int) -> Column:
        top, bottom = self.hold(self.highest(high, n)), self.hold(self.lowest(low, n))
        x = col(x)
        return F.when(x.isNotNull() & (top == bottom), F.lit(50.0)).otherwise(100 * ratio(x - bottom, top - bottom))

    def wpr(self, n: int) -> Column:
        top, bottom, c = self.hold(self.highest("high", n)), self.hold(self.lowest("low", n)), F.col("close")
        return F.when(c.isNotNull() & (top == bottom), F.lit(0.0)).otherwise(100 * ratio(c - top, top - bottom))

    def median(self, x, n: int) -> Column:
        s = F.array_sort(self.window(x, n))
        return (F.get(s, F.lit((n - 1) // 2)) + F.get(s, F.lit(n // 2))) / 2

    def mode(self, x, n: int) -> Column:
        """Of the last n bars' values; the least wins ties."""
        x = self._of(x)
        w = self.hold(F.when(F.col(self.order) >= n - 1, F.collect_list(x).over(self.last(n))))
        counted = F.transform(F.array_distinct(w), lambda v: F.struct((-F.size(F.filter(w, lambda u: u == v))).alias("n"), v.alias("v")))
        return F.array_min(counted)["v"]

    def percentile_nearest_rank(self, x, n: int, p: float = 50.0) -> Column:
        return F.get(F.array_sort(self.window(x, n)), F.lit(min(n - 1, max(0, math.ceil(p / 100 * n) - 1))))

    def percentile_linear_interpolation(self, x, n: int, p: float = 50.0) -> Column:
        s, r = F.array_sort(self.window(x, n)), p / 100 * (n - 1)
        a = min(n - 1, max(0, math.floor(r)))
        b = min(n - 1, a + 1)
        return F.get(s, F.lit(a)) + (F.get(s, F.lit(b)) - F.get(s, F.lit(a))) * (r - a)

    def percentrank(self, x, n: int) -> Column:
        x = self._of(x)
        w = self.window(x, n + 1)
        return 100.0 * (F.size(F.filter(w, lambda v: v <= x)) - 1) / n

    def cog(self, x, n: int) -> Column:
        x = self._of(x)
        total = F.sum(x).over(self.last(n))
        return -ratio(self.full(x, n, (n + 1) * total - self._ramp(x, n)), total)

    def rci(self, x, n: int) -> Column:
        w = self.window(x, n)
        d2 = F.transform(w, lambda v, i: F.pow(F.lit(n) - i - 1 - F.size(F.filter(w, lambda u: u > v)), F.lit(2)))
        return 100 * (1 - 6 * F.aggregate(d2, F.lit(0.0), lambda a, b: a + b) / (n * (n * n - 1)))

    def pivothigh(self, x="high", left: int = 1, right: int = 1) -> Column:
        x, n = self._of(x), left + right + 1
        return self.full(x, n, F.when(F.max(x).over(self.last(n)) == self.lag(x, right), self.lag(x, right)))

    def pivotlow(self, x="low", left: int = 1, right: int = 1) -> Column:
        x, n = self._of(x), left + right + 1
        return self.full(x, n, F.when(F.min(x).over(self.last(n)) == self.lag(x, right), self.lag(x, right)))

    # -- cumulative ------------------------------------------------------------

    def cum(self, x) -> Column:
        return F.coalesce(F.sum(self._of(x)).over(self.past), F.lit(0.0))

    def max(self, x) -> Column:
        return F.max(self._of(x)).over(self.past)

    def min(self, x) -> Column:
        return F.min(self._of(x)).over(self.past)

    def fixnan(self, x) -> Column:
        return F.last(self._of(x), ignorenulls=True).over(self.past)

    def barssince(self, cond) -> Column:
        i = F.col(self.order)
        return i - F.max(F.when(self._of(cond), i)).over(self.past)

    def valuewhen(self, cond, x, k: int = 0) -> Column:
        """x at the k-th latest true; a stored na stays na."""
        cond = self.hold(F.coalesce(col(cond), F.lit(False)))
        own = self.hold(F.when(cond, F.struct(col(x).alias("x"))))
        if k:
            own = self.hold(F.when(cond, F.lag(own, k).over(self._apart(cond))))
            seen = F.sum(cond.cast("int")).over(self.past)
            return F.when(seen > k, F.last(own, ignorenulls=True).over(self.past)["x"])
        return F.last(own, ignorenulls=True).over(self.past)["x"]

    def _running(self, valid: Column, amount) -> Column:
        """Running total over complete bars of amount(lag), from 0 on the first."""
        by = self._apart(valid)
        step = self.hold(F.when(valid, F.coalesce(amount(lambda c: F.lag(c).over(by)), F.lit(0.0))))
        return F.when(valid, F.sum(step).over(self.past))

    def obv(self) -> Column:
        c, v = F.col("close"), F.col("volume")
        return self._running(c.isNotNull() & v.isNotNull(), lambda lag: v * F.signum(c - lag(c)))

    def accdist(self) -> Column:
        c, h, low, v = (F.col(x) for x in ("close", "high", "low", "volume"))
        return self._running(c.isNotNull() & h.isNotNull() & low.isNotNull() & v.isNotNull(), lambda lag: F.when(h == low, F.lit(0.0)).otherwise(ratio((c - low) - (h - c), h - low) * v))

    def pvt(self) -> Column:
        c, v = F.col("close"), F.col("volume")
        return self._running(c.isNotNull() & v.isNotNull(), lambda lag: ratio(c - lag(c), lag(c)) * v)

    def wad(self) -> Column:
        c, h, low = F.col("close"), F.col("high"), F.col("low")
        return self._running(c.isNotNull() & h.isNotNull() & low.isNotNull(), lambda lag: F.when(c > lag(c), c - F.least(low, lag(c))).when(c < lag(c), c - F.greatest(h, lag(c))))

    def vwap(self, x="close", anchor=None, mult: float | None = None):
        """Since the last true anchor; with mult also the bands."""
        x, v = self._of(x), F.col("volume")
        group = self.hold(F.lit(0) if anchor is None else F.sum(F.coalesce(col(anchor), F.lit(False)).cast("int")).over(self.past))
        frame = Window.partitionBy(self.symbol, group).orderBy(self.order).rowsBetween(Window.unboundedPreceding, 0)
        valid = x.isNotNull() & v.isNotNull()
        pv, sv, p2v = (self.hold(F.sum(F.when(valid, y)).over(frame)) for y in (x * v, v, x * x * v))
        mid = self.hold(F.when(valid, ratio(pv, sv)))
        if mult is None:
            return mid
        d = F.sqrt(F.greatest(F.lit(0.0), ratio(p2v, sv) - mid * mid))
        return mid, mid + mult * d, mid - mult * d

    def wvad(self) -> Column:
        o, h, low, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
        return F.when(h == low, F.when((o + c + v).isNotNull(), F.lit(0.0))).otherwise(ratio(c - o, h - low) * v)

    def iii(self) -> Column:
        h, low, c, v = (F.col(x) for x in ("high", "low", "close", "volume"))
        bottom = (h - low) * v
        return F.when(bottom == 0, F.when(c.isNotNull(), F.lit(0.0))).otherwise(ratio(2 * c - h - low, bottom))

    def pivot_point_levels(self, kind: str, anchor, developing: bool = False) -> Column:
        """Array of P, R1, S1 .. R5, S5 of the period before the last anchor, or of the one that runs, up to this bar. Kinds share what they need of an anchor."""
        if developing and kind in ("Woodie", "DM"):
            raise ValueError(f"{kind} levels cannot be developing")
        key = str(anchor)
        if key not in self._periods:
            self._periods[key] = self._period(anchor)
        group, before = self._periods[key]
        if developing:
            own = Window.partitionBy(self.symbol, group).orderBy(self.order).rowsBetween(Window.unboundedPreceding, 0)
            none = F.lit(None).cast("double")
            levels = pivot_levels(kind, none, self.hold(F.max("high").over(own)), self.hold(F.min("low").over(own)), F.col("close"), none)
            return self.hold(F.array(*[F.lit(None).cast("double") if x is None else x for x in levels]))
        levels = pivot_levels(kind, *map(F.col, before))
        return self.hold(F.when(group > 0, F.array(*[F.lit(None).cast("double") if x is None else x for x in levels])))

    def _period(self, anchor) -> tuple[Column, list[str]]:
        """The number of anchors so far, and columns open, high, low, close of the period before and the first open of this one."""
        n = len(self._periods)
        group = self.hold(F.sum(F.coalesce(col(anchor), F.lit(False)).cast("int")).over(self.past))
        i = F.col(self.order)
        sums = self.df.groupBy(F.col(self.symbol).alias("__sym"), group.alias("__g")).agg(F.max("high").alias("__h"), F.min("low").alias("__l"), F.max_by("close", F.when(F.col("close").isNotNull(), i)).alias("__c"), F.min_by("open", F.when(F.col("open").isNotNull(), i)).alias("__o"), F.min_by("open", i).alias("__first"))
        by = Window.partitionBy("__sym").orderBy("__g")
        names = [f"__p{n}_{x}" for x in ("o", "h", "l", "c", "first")]
        prev = sums.select("__sym", "__g", *[F.lag(c).over(by).alias(k) for k, c in zip(names, ("__o", "__h", "__l", "__c"), strict=False)], F.col("__first").alias(names[4]))
        self.df = self.df.join(prev, (F.col(self.symbol) == F.col("__sym")) & (group == F.col("__g")), "left").drop("__sym", "__g")
        return group, names


def pivot_levels(kind: str, opened: Column, high: Column, low: Column, close: Column, now_open: Column) -> list:
    """P, R1, S1 .. R5, S5; None where the kind has no such level."""
    out: list = [None] * 11
    r, third = high - low, (high + low + close) / 3
    p, up, down = third, [], []
    if kind == "Traditional":
        up = [2 * p - low, p + r] + [p * k + (high - k * low) for k in (2, 3, 4)]
        down = [2 * p - high, p - r] + [p * k - (k * high - low) for k in (2, 3, 4)]
    elif kind == "Fibonacci":
        up, down = [p + k * r for k in (0.382, 0.618, 1.0)], [p - k * r for k in (0.382, 0.618, 1.0)]
    elif kind == "Woodie":
        p = (high + low + 2 * now_open) / 4
        a, b = high + 2 * (p - low), low - 2 * (high - p)
        up, down = [2 * p - low, p + r, a, a + r], [2 * p - high, p - r, b, b - r]
    elif kind == "Classic":
        up, down = [2 * p - low] + [p + k * r for k in (1, 2, 3)], [2 * p - high] + [p - k * r for k in (1, 2, 3)]
    elif kind == "DM":
        x = F.when(opened == close, high + low + 2 * close).when(close > opened, 2 * high + low + close).otherwise(2 * low + high + close)
        x = F.when(opened.isNotNull(), x)
        p, up, down = x / 4, [x / 2 - low], [x / 2 - high]
    elif kind == "Camarilla":
        up, down = [close + 1.1 * r / k for k in (12, 6, 4, 2)], [close - 1.1 * r / k for k in (12, 6, 4, 2)]
        up.append(up[3] + 1.168 * (up[3] - up[2]))
        down.append(down[3] - 1.168 * (down[2] - down[3]))
    else:
        return out
    out[0] = p
    out[1 : 1 + 2 * len(up) : 2] = up
    out[2 : 2 + 2 * len(down) : 2] = down
    return out
