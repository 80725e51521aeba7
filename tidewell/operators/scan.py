"""Recursive operators over bars: one ordered pass per symbol, in the states of ``functions.series``.

Bars are dealt out by symbol and sorted; each task then runs through its rows batch by
batch and keeps only the operators' states, so a symbol's length is not bounded by memory.
All operators of a call share the pass.  Where a state has a kernel (``functions.kernels``)
it takes a symbol's rows of a batch at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import kernels, series

#: name -> (maker of a state, its bar inputs, where "" is the series that is given, values per bar)
RECURSIVE = {
    "ema": (series.Ema, ("",), 1),
    "rma": (series.Rma, ("",), 1),
    "dema": (series.Dema, ("",), 1),
    "rsi": (series.Rsi, ("",), 1),
    "atr": (series.Atr, ("high", "low", "close"), 1),
    "macd": (series.Macd, ("",), 3),
    "tsi": (series.Tsi, ("",), 1),
    "kc": (series.Keltner, ("", "high", "low", "close"), 3),
    "kcw": (series.KeltnerWidth, ("", "high", "low", "close"), 1),
    "supertrend": (series.Supertrend, ("high", "low", "close"), 2),
    "sar": (series.Sar, ("high", "low", "close"), 1),
    "dmi": (series.Dmi, ("high", "low", "close"), 3),
    "nvi": (lambda: series.VolumeIndex(-1), ("close", "volume"), 1),
    "pvi": (lambda: series.VolumeIndex(1), ("close", "volume"), 1),
    "random": (lambda: series.Random(1), (), 1),
    # windows whose length is a series of its own, or that freeze
    "cci": (series.Cci, ("",), 1),
    "cmo": (series.Cmo, ("",), 1),
    "mode": (series.Mode, ("",), 1),
    "hma": (series.Hma, ("",), 1),
    "highest": (lambda: series.Over(max, short=-np.inf), ("",), 1),
    "lowest": (lambda: series.Over(min, short=np.inf), ("",), 1),
    "sma": (lambda: series.Over(series.mean), ("",), 1),
    "wma": (lambda: series.Over(series.weighted_mean), ("",), 1),
    "median": (lambda: series.Over(series.middle), ("",), 1),
    "vwma": (series.Vwma, ("", "volume"), 1),
    "stdev": (lambda: series.Over(lambda w: series.population_variance(w) ** 0.5), ("",), 1),
    "linreg": (lambda: series.Over(series.regression), ("",), 1),
    "highestbars": (lambda: series.Over(series.newest_extreme), ("",), 1),
    "lowestbars": (lambda: series.Over(lambda w: series.newest_extreme(w, False)), ("",), 1),
    "sum": (series.Sum, ("",), 1),
    "range": (series.Range, ("",), 1),
    "percentile_nearest_rank": (lambda: series.Over(series.nearest_rank), ("",), 1),
    "percentile_linear_interpolation": (lambda: series.Over(series.linear_percentile), ("",), 1),
    "pivothigh": (lambda: series.Pivot(True), ("",), 1),
    "pivotlow": (lambda: series.Pivot(False), ("",), 1),
}


def op(name: str, *params, of: str = "close", to: str | tuple[str, ...] | None = None) -> tuple:
    """An operator of a scan: its name, parameters (numbers, or names of columns that vary by bar), the series it is of, and the names of its values."""
    make, inputs, values = RECURSIVE[name]
    names = (to,) if isinstance(to, str) else tuple(to or (name if values == 1 else f"{name}_{i}" for i in range(values)))
    if len(names) != values:
        raise ValueError(f"{name} gives {values} values")
    return make, [of if x == "" else x for x in inputs], list(params), names


def scan(bars: DataFrame, *ops: tuple, symbol: str = "symbol", order: str = "bar_index") -> DataFrame:
    """bars with a double column for every value of the operators; na is null."""
    needed = list(dict.fromkeys(c for _, inputs, params, _ in ops for c in [*inputs, *[p for p in params if isinstance(p, str)]]))
    made = [n for _, _, _, names in ops for n in names]
    keep = [c for c in bars.columns if c not in made]
    rows = bars.select(*keep)

    def starts() -> list[tuple[object, list, int]]:
        """(state, its arguments as (whether it varies, place among needed or number), values) of each operator."""
        out = []
        for make, inputs, params, names in ops:
            at = [needed.index(c) for c in inputs] + [needed.index(p) if isinstance(p, str) else p for p in params]
            out.append((make(), [(isinstance(p, str) or k < len(inputs), a) for k, (p, a) in enumerate(zip([*inputs, *params], at, strict=True))], len(names)))
        return out

    def run(batches):
        now, states = None, None
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in needed]
            codes = batch.column(symbol).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
            out = [np.empty(len(codes)) for _ in made]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                own = batch.column(symbol)[a].as_py()
                if states is None or own != now:
                    now, states = own, starts()
                k = 0
                for state, args, values in states:
                    got = kernels.steps(state, [cols[x][a:b] if varies else x for varies, x in args], b - a, values)
                    for j in range(values):
                        out[k + j][a:b] = got[j]
                    k += values
            arrays = [pa.array(o, from_pandas=True) for o in out]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, *made])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [f"`{n}` double" for n in made])
    return rows.repartition(F.col(symbol)).sortWithinPartitions(symbol, order).mapInArrow(run, schema)
