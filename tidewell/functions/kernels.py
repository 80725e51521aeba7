"""States of series operators that take many bars at once, in numpy.

A kernel leaves its state as the same bars one by one would, so either can go on from the
other; values agree but for the order of sums.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

from tidewell.functions import series

#: Bars of a block of a smoothing, which is one product with a triangular matrix.
BLOCK = 64


def steps(state, args: list, n: int, values: int) -> list[np.ndarray]:
    """``values`` arrays for n bars; args are arrays, or numbers that hold for all bars."""
    kernel = KERNELS.get(type(state))
    if kernel and all(isinstance(a, np.ndarray) for a in args[: kernel[1]]) and not any(isinstance(a, np.ndarray) for a in args[kernel[1] :]):
        out = kernel[0](state, *args)
        return [out] if values == 1 else list(out)
    step = state.step
    rows = zip(*[a.tolist() if isinstance(a, np.ndarray) else [a] * n for a in args], strict=True) if args else ((),) * n
    got = [step(*row) for row in rows]
    return [np.asarray(got, np.float64)] if values == 1 else list(np.asarray(got, np.float64).reshape(n, values).T)


@lru_cache(maxsize=64)
def _decay(weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Shares of a block's values in each of its smoothed ones, and those of the one before it."""
    i = np.arange(BLOCK)
    back = i[:, None] - i[None, :]
    own = np.where(back >= 0, weight * (1 - weight) ** np.maximum(back, 0), 0.0)
    return own.T.copy(), (1 - weight) ** (i + 1)


def _recurrence(x: np.ndarray, weight: float, last: float) -> np.ndarray:
    """y = weight * x + (1 - weight) * y before it, from ``last`` on."""
    own, decay = _decay(weight)
    out = np.empty(len(x))
    whole = len(x) // BLOCK * BLOCK
    if whole:
        blocks = x[:whole].reshape(-1, BLOCK) @ own
        carry, ends, keep = np.empty(len(blocks)), blocks[:, -1].tolist(), float(decay[-1])
        for i, end in enumerate(ends):
            carry[i] = last
            last = end + keep * last
        blocks += carry[:, None] * decay
        out[:whole] = blocks.ravel()
    for i in range(whole, len(x)):
        last = weight * x[i] + (1 - weight) * last
        out[i] = last
    return out


def smoothed(state: series.Smoothed, x: np.ndarray, n) -> np.ndarray:
    out = np.full(len(x), math.nan)
    n, there = int(n), np.flatnonzero(~np.isnan(x))
    seeds = there[: max(0, n - state.count)]
    if len(seeds):
        state.value = float(np.cumsum(np.concatenate(([state.value], x[seeds])))[-1])
        state.count += len(seeds)
        if state.count < n:
            return out
        state.value /= n
        out[seeds[-1]] = state.value
    rest = there[len(seeds) :]
    if len(rest):
        out[rest] = _recurrence(x[rest], state.alpha(n), state.value)
        state.value = float(out[rest[-1]])
    return out


def dema(state: series.Dema, x, n):
    a = smoothed(state.one, x, n)
    return 2 * a - smoothed(state.two, a, n)


def macd(state: series.Macd, x, fast, slow, signal):
    m = smoothed(state.fast, x, fast) - smoothed(state.slow, x, slow)
    s = smoothed(state.signal, m, signal)
    return m, s, m - s


def rsi(state: series.Rsi, x, n):
    out = np.full(len(x), math.nan)
    n, there = int(n), np.flatnonzero(~np.isnan(x))
    if not len(there):
        return out
    v = x[there]
    d = np.diff(np.concatenate(([state.last], v)))
    got, first = np.full(len(v), math.nan), 0
    while first < len(v) and state.seen < max(n, 1):  # the seed, bar by bar
        got[first] = state.step(float(v[first]), n)
        first += 1
    if first < len(v):
        up = _recurrence(np.maximum(d[first:], 0.0), 1 / n, state.up)
        down = _recurrence(np.maximum(-d[first:], 0.0), 1 / n, state.down)
        state.up, state.down, state.last, state.seen = float(up[-1]), float(down[-1]), float(v[-1]), state.seen + len(v) - first
        with np.errstate(divide="ignore", invalid="ignore"):
            got[first:] = np.where(down == 0, 100.0, 100 - 100 / (1 + up / down))
    out[there] = got
    return out


#: state -> (kernel, how many of its arguments are series)
KERNELS = {series.Ema: (smoothed, 1), series.Rma: (smoothed, 1), series.Dema: (dema, 1), series.Macd: (macd, 1), series.Rsi: (rsi, 1)}
