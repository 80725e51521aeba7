"""Bar-by-bar states of the series operators.

Each class is one operator at one place of use: ``step`` takes a bar's inputs and gives
its value.  na is NaN.  The same states run in the ordered scans over symbols, in the
script interpreter and in streaming queries; states are small and can be pickled.

What na does: *poison* - any na in the window gives na; *freeze* - an na input gives na
and changes nothing; *skip* - na is left out; *carry* - the last value stays.
"""

from __future__ import annotations

import math
from collections import deque

NAN = math.nan
isnan = math.isnan


# -- functions of a window (oldest first, no na in it) --------------------------------


def mean(w):
    return sum(w) / len(w)


def weighted_mean(w):
    n = len(w)
    return sum(v * (i + 1) for i, v in enumerate(w)) / (n * (n + 1) / 2)


def population_variance(w):
    m = mean(w)
    return max(0.0, sum((v - m) ** 2 for v in w) / len(w))


def mean_deviation(w):
    m = mean(w)
    return sum(abs(v - m) for v in w) / len(w)


def middle(w):
    s = sorted(w)
    n = len(s)
    return s[n // 2] if n % 2 else (s[n // 2 - 1] + s[n // 2]) / 2


def regression(w, offset=0):
    """Least squares over 0 .. n - 1, taken at n - 1 + offset."""
    n = len(w)
    if n == 1:
        return w[0]
    mx, my = (n - 1) / 2, mean(w)
    slope = sum((i - mx) * (v - my) for i, v in enumerate(w)) / (n * (n * n - 1) / 12)
    return my + slope * (n - 1 + offset - mx)


def nearest_rank(w, p=50.0):
    s = sorted(w)
    return s[min(len(s) - 1, max(0, math.ceil(p / 100 * len(s)) - 1))]


def linear_percentile(w, p=50.0):
    s = sorted(w)
    r = p / 100 * (len(s) - 1)
    a = min(len(s) - 1, max(0, math.floor(r)))
    b = min(len(s) - 1, a + 1)
    return s[a] + (s[b] - s[a]) * (r - a)


def gravity(w):
    total = sum(w)
    return NAN if total == 0 else -sum(v * (i + 1) for i, v in enumerate(reversed(w))) / total


def rank_correlation(w):
    """Of time and price; ties rank by how many are strictly greater."""
    n = len(w)
    if n < 2:
        return NAN
    d2 = sum((n - i - (1 + sum(x > v for x in w))) ** 2 for i, v in enumerate(w))
    return 100 * (1 - 6 * d2 / (n * (n * n - 1)))


def gaussian(w, offset=0.85, sigma=6.0):
    n = len(w)
    m, s = offset * (n - 1), n / sigma if sigma else 0.0
    if s == 0:
        return NAN
    k = [math.exp(-((i - m) ** 2) / (2 * s * s)) for i in range(n)]
    total = sum(k)
    return NAN if total == 0 else sum(a * b for a, b in zip(w, k, strict=True)) / total


def newest_extreme(w, top=True):
    """Minus the bars since the extreme; the newest wins ties."""
    best = max(w) if top else min(w)
    return -next(i for i, v in enumerate(reversed(w)) if v == best)


def commonest(w):
    counts: dict[float, int] = {}
    for v in w:
        counts[v] = counts.get(v, 0) + 1
    return min(counts, key=lambda v: (-counts[v], v)) if counts else NAN


class Over:
    """A function of the last n values; poison. n may change from bar to bar if ``keep`` is None; else ``keep`` values are kept at most."""

    def __init__(self, f, keep: int | None = None, short=NAN):
        self.f, self.past, self.short = f, deque(maxlen=keep) if keep else [], short

    def step(self, x, n, *more):
        self.past.append(x)
        if n != n or x is None:
            return NAN
        n = int(n)
        if n < 1:
            return self.short
        if n > len(self.past):
            return NAN
        w = list(self.past)[-n:] if isinstance(self.past, deque) else self.past[-n:]
        return NAN if any(map(isnan, w)) else self.f(w, *more)


class Lagged:
    """The value k bars ago."""

    def __init__(self, keep: int | None = None):
        self.past = deque(maxlen=keep + 1) if keep is not None else []

    def step(self, x, k):
        self.past.append(x)
        if k != k or k < 0 or int(k) >= len(self.past):
            return NAN
        return self.past[-1 - int(k)]


class Change(Lagged):
    def step(self, x, k=1):
        return x - super().step(x, k)


class Roc(Lagged):
    def step(self, x, k):
        base = super().step(x, k)
        return NAN if base == 0 else 100 * (x - base) / base


class Sum:
    """Of the last n values, na as 0, without warm-up."""

    def __init__(self):
        self.past = []

    def step(self, x, n):
        self.past.append(0.0 if isnan(x) else x)
        return NAN if n != n else math.fsum(self.past[-int(n) :]) if n >= 1 else 0.0


class Vwma:
    def __init__(self):
        self.pv, self.v = Over(sum), Over(sum)

    def step(self, x, volume, n):
        a, b = self.pv.step(x * volume, n), self.v.step(volume, n)
        return NAN if b == 0 else a / b


class Hma:
    """wma(2 wma(n/2) - wma(n), sqrt n); the outer one sees bars where both inner ones are there."""

    def __init__(self):
        self.half, self.full, self.outer = Over(weighted_mean), Over(weighted_mean), Over(weighted_mean)

    def step(self, x, n):
        a, b = self.half.step(x, max(1, int(n / 2))), self.full.step(x, max(1, int(n)))
        return NAN if isnan(a) or isnan(b) else self.outer.step(2 * a - b, max(1, int(math.sqrt(n))))


class Swma:
    def __init__(self):
        self.w = Over(lambda w: (w[0] + 2 * w[1] + 2 * w[2] + w[3]) / 6, 4)

    def step(self, x):
        return self.w.step(x, 4)


class Bands:
    """Middle, upper and lower."""

    def __init__(self):
        self.w = Over(lambda w: (mean(w), math.sqrt(population_variance(w))))

    def step(self, x, n, mult):
        found = self.w.step(x, n)
        if found is NAN or not isinstance(found, tuple):
            return NAN, NAN, NAN
        m, d = found
        return m, m + mult * d, m - mult * d


class BandWidth(Bands):
    def step(self, x, n, mult):
        m, up, low = super().step(x, n, mult)
        return NAN if isnan(m) or m == 0 else (up - low) / m * 100


class Cci:
    """Poison until the first value, then na bars are left out of the window."""

    def __init__(self):
        self.w, self.on = None, False

    def step(self, x, n):
        self.w = self.w if self.w is not None else deque(maxlen=int(n))
        if self.on and isnan(x):
            return NAN
        self.w.append(x)
        if len(self.w) < int(n) or (not self.on and any(map(isnan, self.w))):
            return NAN
        self.on = True
        d = mean_deviation(self.w)
        return 0.0 if d == 0 else (x - mean(self.w)) / (0.015 * d)


class Cmo:
    def __init__(self):
        self.last, self.moves = NAN, None

    def step(self, x, n):
        self.moves = self.moves if self.moves is not None else deque(maxlen=int(n))
        d, self.last = x - self.last, x
        if isnan(d):
            return NAN
        self.moves.append(d)
        if len(self.moves) < int(n):
            return NAN
        up, down = sum(m for m in self.moves if m > 0), -sum(m for m in self.moves if m < 0)
        return 0.0 if up + down == 0 else 100 * (up - down) / (up + down)


class Mfi:
    """Freeze; flows count once two prices are there."""

    def __init__(self):
        self.last, self.flows = NAN, None

    def step(self, x, volume, n):
        self.flows = self.flows if self.flows is not None else deque(maxlen=int(n))
        if isnan(x) or isnan(volume):
            return NAN
        last, self.last = self.last, x
        if isnan(last):
            return NAN
        self.flows.append(x * volume * ((x > last) - (x < last)))
        if len(self.flows) < int(n):
            return NAN
        up, down = sum(f for f in self.flows if f > 0), -sum(f for f in self.flows if f < 0)
        return 100.0 if down == 0 else 100 - 100 / (1 + up / down)


class Mode:
    """Of the last n values without na; the least wins ties."""

    def __init__(self):
        self.past = []

    def step(self, x, n):
        self.past.append(x)
        n = int(n)
        return NAN if len(self.past) < n else commonest([v for v in self.past[-n:] if not isnan(v)])


class PercentRank:
    def __init__(self):
        self.w = Over(lambda w: 100 * sum(v <= w[-1] for v in w[:-1]) / (len(w) - 1))

    def step(self, x, n):
        return self.w.step(x, int(n) + 1)


class Correlation:
    def __init__(self):
        self.x, self.y = Over(list), Over(list)

    def step(self, x, y, n):
        a, b = self.x.step(x, n), self.y.step(y, n)
        if not isinstance(a, list) or not isinstance(b, list):
            return NAN
        ma, mb = mean(a), mean(b)
        va, vb = sum((v - ma) ** 2 for v in a), sum((v - mb) ** 2 for v in b)
        return NAN if va <= 0 or vb <= 0 else sum((p - ma) * (q - mb) for p, q in zip(a, b, strict=True)) / math.sqrt(va * vb)


class Stoch:
    def __init__(self):
        self.high, self.low = Over(max), Over(min)

    def step(self, x, high, low, n):
        top, bottom = self.high.step(high, n), self.low.step(low, n)
        if isnan(top) or isnan(bottom) or isnan(x):
            return NAN
        return 50.0 if top == bottom else 100 * (x - bottom) / (top - bottom)


class Wpr(Stoch):
    def step(self, high, low, close, n):
        top, bottom = self.high.step(high, n), self.low.step(low, n)
        if isnan(top) or isnan(bottom) or isnan(close):
            return NAN
        return 0.0 if top == bottom else 100 * (close - top) / (top - bottom)


class Range:
    def __init__(self):
        self.w = Over(lambda w: max(w) - min(w), short=-math.inf)

    def step(self, x, n):
        return self.w.step(x, n)


class Pivot:
    """The value ``right`` bars ago if none of the bars to either side goes beyond it."""

    def __init__(self, top: bool):
        self.sign, self.past = 1 if top else -1, []

    def step(self, x, left, right):
        self.past.append(x)
        if left != left or right != right:
            return NAN
        left, right = int(left), int(right)
        at = len(self.past) - 1 - right
        if right < 0 or not 0 <= at - max(0, left):
            return NAN
        own = self.past[at]
        near = self.past[at - max(0, left) : at + right + 1]
        return NAN if any(isnan(v) or self.sign * v > self.sign * own for v in near) else own


class Cross:
    """Whether a crosses b upwards (1), downwards (-1), or either (0); na is never a cross."""

    def __init__(self, way: int):
        self.way, self.a, self.b = way, NAN, NAN

    def step(self, a, b):
        up = self.a <= self.b and a > b
        down = self.a >= self.b and a < b
        self.a, self.b = a, b
        return up if self.way > 0 else down if self.way < 0 else up or down


class Streak:
    """Whether x has risen (or fallen) strictly for n bars; na starts anew."""

    def __init__(self, way: int):
        self.way, self.last, self.run = way, NAN, 0

    def step(self, x, n):
        d, self.last = self.way * (x - self.last), x
        self.run = self.run + 1 if d > 0 else 0
        return self.run >= int(n)


class TrueRange:
    def __init__(self, handle_na=True):
        self.last, self.handle_na = NAN, handle_na

    def step(self, high, low, close, handle_na=None):
        last, self.last = self.last, close
        if isnan(last):
            return high - low if (self.handle_na if handle_na is None else handle_na) else NAN
        if isnan(high) or isnan(low):
            return NAN
        return max(high - low, abs(high - last), abs(low - last))


# -- cumulative -----------------------------------------------------------------------


class Cum:
    def __init__(self):
        self.total = 0.0

    def step(self, x):
        self.total += 0.0 if isnan(x) else x
        return self.total


class Extreme:
    """Greatest (or least) so far; carry."""

    def __init__(self, top: bool):
        self.top, self.best = top, NAN

    def step(self, x):
        if not isnan(x) and (isnan(self.best) or (x > self.best if self.top else x < self.best)):
            self.best = x
        return self.best


class BarsSince:
    def __init__(self):
        self.n = NAN

    def step(self, cond):
        self.n = 0 if truth(cond) else self.n + 1
        return self.n


class ValueWhen:
    def __init__(self):
        self.seen = []

    def step(self, cond, x, k=0):
        k = int(k)
        if truth(cond):
            self.seen.append(x)
            del self.seen[: -k - 1]
        return self.seen[-1 - k] if len(self.seen) > k else NAN


class FixNan:
    def __init__(self):
        self.last = NAN

    def step(self, x):
        self.last = self.last if isnan(x) else x
        return self.last


class Accumulated:
    """A running total of amounts per bar from (bar, previous complete bar); freeze."""

    def __init__(self, amount, first):
        self.amount, self.first, self.total, self.last = amount, first, None, None

    def step(self, *bar):
        if any(map(isnan, bar)):
            return NAN
        if self.total is None:
            self.total = self.first(bar)
        else:
            self.total += self.amount(bar, self.last)
        self.last = bar
        return self.total


def zero(bar):
    return 0.0


def obv_amount(bar, last):
    return bar[1] * ((bar[0] > last[0]) - (bar[0] < last[0]))


def accdist_amount(bar, last=None):
    close, high, low, volume = bar
    return 0.0 if high == low else ((close - low) - (high - close)) / (high - low) * volume


def pvt_amount(bar, last):
    return 0.0 if last[0] == 0 else (bar[0] - last[0]) / last[0] * bar[1]


def wad_amount(bar, last):
    high, low, close = bar
    before = last[2]
    return close - min(low, before) if close > before else close - max(high, before) if close < before else 0.0


class VolumeIndex:
    """Compounds price changes on bars of falling (-1) or rising (1) volume, from 1; freeze."""

    def __init__(self, way: int):
        self.way, self.value, self.last = way, 1.0, None

    def step(self, close, volume):
        if isnan(close) or isnan(volume):
            return NAN
        if self.last and self.last[0] != 0 and self.way * (volume - self.last[1]) > 0:
            self.value += (close - self.last[0]) / self.last[0] * self.value
        self.last = close, volume
        return self.value


class Vwap:
    """Middle, upper and lower, from the last anchor on."""

    def __init__(self):
        self.pv = self.v = self.p2v = 0.0

    def step(self, x, volume, anchor=False, mult=NAN):
        if anchor is True:
            self.pv = self.v = self.p2v = 0.0
        if isnan(x) or isnan(volume):
            return NAN, NAN, NAN
        self.pv += x * volume
        self.v += volume
        self.p2v += x * x * volume
        if self.v == 0:
            return NAN, NAN, NAN
        m = self.pv / self.v
        d = math.sqrt(max(0.0, self.p2v / self.v - m * m))
        return m, m + mult * d, m - mult * d


# -- recursive ------------------------------------------------------------------------


class Smoothed:
    """Exponential smoothing with weight alpha(n), seeded by the mean of the first n values; freeze."""

    def __init__(self, alpha):
        self.alpha, self.count, self.value = alpha, 0, 0.0

    def step(self, x, n):
        if isnan(x):
            return NAN
        n = int(n)
        if self.count < n:
            self.count += 1
            self.value += x
            if self.count < n:
                return NAN
            self.value /= n
        else:
            a = self.alpha(n)
            self.value = a * x + (1 - a) * self.value
        return self.value


def ema_weight(n):
    return 2 / (n + 1)


def wilder_weight(n):
    return 1 / n


class Ema(Smoothed):
    def __init__(self):
        super().__init__(ema_weight)


class Rma(Smoothed):
    def __init__(self):
        super().__init__(wilder_weight)


class Dema:
    def __init__(self):
        self.one, self.two = Ema(), Ema()

    def step(self, x, n):
        a = self.one.step(x, n)
        return 2 * a - self.two.step(a, n)


class Rsi:
    """Wilder's; the seed falls on the n-th value, so it divides n - 1 changes by n. No losses give 100; freeze."""

    def __init__(self):
        self.seen, self.last, self.up, self.down = 0, NAN, 0.0, 0.0

    def step(self, x, n):
        if isnan(x):
            return NAN
        n = int(n)
        d, self.last = x - self.last, x
        self.seen += 1
        if self.seen == 1:
            return NAN
        up, down = max(d, 0.0), max(-d, 0.0)
        if self.seen <= n:
            self.up, self.down = self.up + up, self.down + down
            if self.seen < n:
                return NAN
            self.up, self.down = self.up / n, self.down / n
        else:
            self.up, self.down = (self.up * (n - 1) + up) / n, (self.down * (n - 1) + down) / n
        return 100.0 if self.down == 0 else 100 - 100 / (1 + self.up / self.down)


class Atr:
    def __init__(self):
        self.tr, self.mean = TrueRange(), Rma()

    def step(self, high, low, close, n):
        return self.mean.step(self.tr.step(high, low, close), n)


class Macd:
    def __init__(self):
        self.fast, self.slow, self.signal = Ema(), Ema(), Ema()

    def step(self, x, fast, slow, signal):
        m = self.fast.step(x, fast) - self.slow.step(x, slow)
        s = self.signal.step(m, signal)
        return m, s, m - s


class Tsi:
    def __init__(self):
        self.last, self.s = NAN, [Ema() for _ in range(4)]

    def step(self, x, short, long):
        if isnan(x):
            return NAN
        d, self.last = x - self.last, x
        if isnan(d):
            return NAN
        a = self.s[2].step(self.s[0].step(d, long), short)
        b = self.s[3].step(self.s[1].step(abs(d), long), short)
        return NAN if isnan(a) or isnan(b) else 0.0 if b == 0 else a / b


class Keltner:
    def __init__(self):
        self.mid, self.atr = Ema(), Atr()

    def step(self, x, high, low, close, n, mult, true_range=True):
        m, r = self.mid.step(x, n), self.atr.step(high, low, close, n)
        r = r if true_range else high - low
        return (NAN, NAN, NAN) if isnan(m) or isnan(r) else (m, m + mult * r, m - mult * r)


class KeltnerWidth(Keltner):
    def step(self, *args):
        m, up, low = super().step(*args)
        return NAN if isnan(m) or m == 0 else (up - low) / m * 100


class Supertrend:
    """Line and direction; 1 is up, with the lower band as line."""

    def __init__(self):
        self.atr, self.held = Atr(), None

    def step(self, high, low, close, factor, n):
        reach = factor * self.atr.step(high, low, close, n)
        if isnan(reach):
            return NAN, 0.0
        mid = (high + low) / 2
        up, down, way, before = self.held or (mid + reach, mid - reach, 1, close)
        new_way = 1 if way == -1 and close > up else -1 if way == 1 and close < down else way
        new_up = mid + reach if mid + reach < up or before > up else up
        new_down = mid - reach if mid - reach > down or before < down else down
        self.held = new_up, new_down, new_way, close
        return (new_down if new_way == 1 else new_up), float(new_way)


class Sar:
    """Parabolic stop and reverse; na on the first bar; freeze."""

    def __init__(self):
        self.bars = []  # the last two
        self.stop = self.best = self.rate = NAN
        self.rising = False

    def step(self, high, low, close, start, inc, most):
        if isnan(high) or isnan(low) or isnan(close):
            return NAN
        bars, self.bars = self.bars, [*self.bars[-1:], (high, low, close)]
        if not bars:
            return NAN
        if isnan(self.stop):
            fresh = True
            self.rising, self.rate = close > bars[-1][2], start
            self.best = high if self.rising else low
            self.stop = bars[-1][1] if self.rising else bars[-1][0]
        else:
            fresh = False
        self.stop += self.rate * (self.best - self.stop)
        if self.stop > low if self.rising else self.stop < high:
            fresh = True
            self.stop = max(high, self.best) if self.rising else min(low, self.best)
            self.rising = not self.rising
            self.best, self.rate = (high if self.rising else low), start
        if not fresh and (high > self.best if self.rising else low < self.best):
            self.best = high if self.rising else low
            self.rate = min(self.rate + inc, most)
        edge = [b[1] if self.rising else b[0] for b in bars]
        self.stop = min(self.stop, *edge) if self.rising else max(self.stop, *edge)
        return self.stop


class Dmi:
    """+DI, -DI and ADX; smoothing starts from one bar's values."""

    def __init__(self):
        self.calls, self.last, self.s, self.adx = 0, (NAN, NAN, NAN), None, Rma()

    def step(self, high, low, close, n, adx_n):
        last, self.last = self.last, (high, low, close)
        self.calls += 1
        none = NAN, NAN, NAN
        if self.calls < int(n) + 1 or any(map(isnan, (*last, *self.last))):
            return none
        up, down = high - last[0], last[1] - low
        now = max(high - low, abs(high - last[2]), abs(low - last[2])), up if up > down and up > 0 else 0.0, down if down > up and down > 0 else 0.0
        if self.s is None:
            self.s = now
            return none
        a = 1 / int(n)
        self.s = tuple(a * x + (1 - a) * y for x, y in zip(now, self.s, strict=True))
        tr, plus, minus = self.s
        if tr == 0:
            return none
        plus, minus = 100 * plus / tr, 100 * minus / tr
        both = plus + minus
        return plus, minus, self.adx.step(abs(plus - minus) / both * 100 if both > 0 else 0.0, adx_n)


class Random:
    """Uniform in [low, high) by a 32-bit xorshift per place of use; a seed argument starts it anew at every call."""

    def __init__(self, site: int = 0):
        self.x = self.mixed(site)

    @staticmethod
    def mixed(seed):
        m = 0xFFFFFFFF
        h = (int(seed) & m) ^ 0x9E3779B9
        h = (h ^ h >> 16) * 0x85EBCA6B & m
        h = (h ^ h >> 13) * 0xC2B2AE35 & m
        return (h ^ h >> 16) or 1

    def step(self, low=0.0, high=1.0, seed=NAN):
        if not isnan(seed):
            self.x = self.mixed(seed)
        x = self.x
        x ^= x << 13 & 0xFFFFFFFF
        x ^= x >> 17
        x ^= x << 5 & 0xFFFFFFFF
        self.x = x
        return low + x / 4294967296 * (high - low)


def pivot_levels(kind: str, opened, high, low, close, now_open):
    """P, R1, S1 .. R5, S5 of a period; na where the kind has no such level."""
    out = [NAN] * 11
    r = high - low
    third = (high + low + close) / 3
    if kind == "Traditional":
        p = third
        up, down = [2 * p - low, p + r], [2 * p - high, p - r]
        for k in (2, 3, 4):
            up.append(p * k + (high - k * low))
            down.append(p * k - (k * high - low))
    elif kind == "Fibonacci":
        p = third
        steps = [0.382 * r, 0.618 * r, r]
        up, down = [p + s for s in steps], [p - s for s in steps]
    elif kind == "Woodie":
        p = (high + low + 2 * now_open) / 4
        third_up, third_down = high + 2 * (p - low), low - 2 * (high - p)
        up, down = [2 * p - low, p + r, third_up, third_up + r], [2 * p - high, p - r, third_down, third_down - r]
    elif kind == "Classic":
        p = third
        up, down = [2 * p - low, p + r, p + 2 * r, p + 3 * r], [2 * p - high, p - r, p - 2 * r, p - 3 * r]
    elif kind == "DM":
        x = NAN if isnan(opened) else high + low + 2 * close if opened == close else 2 * high + low + close if close > opened else 2 * low + high + close
        p, up, down = x / 4, [x / 2 - low], [x / 2 - high]
    elif kind == "Camarilla":
        p = third
        steps = [1.1 * r / d for d in (12, 6, 4, 2)]
        up, down = [close + s for s in steps], [close - s for s in steps]
        up.append(up[3] + 1.168 * (up[3] - up[2]))
        down.append(down[3] - 1.168 * (down[2] - down[3]))
    else:
        return out
    out[0] = p
    out[1 : 1 + 2 * len(up) : 2] = up
    out[2 : 2 + 2 * len(down) : 2] = down
    return out


class PivotLevels:
    """Levels of the period before the last anchor, or of the period that runs (developing)."""

    def __init__(self):
        self.levels, self.opened, self.high, self.low, self.close, self.on = [NAN] * 11, NAN, NAN, NAN, NAN, False

    def step(self, open_, high, low, close, kind, anchor, developing=False):
        if developing is True and kind in ("Woodie", "DM"):
            raise ValueError(f"{kind} levels cannot be developing")
        if anchor is True or not self.on:
            if anchor is True and self.on and developing is not True:
                self.levels = pivot_levels(kind, self.opened, self.high, self.low, self.close, open_)
            self.opened, self.high, self.low, self.on = open_, high, low, True
        else:
            self.high = high if not isnan(high) and not self.high >= high else self.high
            self.low = low if not isnan(low) and not self.low <= low else self.low
            self.opened = open_ if isnan(self.opened) else self.opened
        if developing is True:
            self.levels = pivot_levels(kind, NAN, self.high, self.low, close, NAN)
        self.close = self.close if isnan(close) else close
        return list(self.levels)


def truth(x) -> bool:
    """Of a condition: na, null and zero are false."""
    return bool(x) and x == x
