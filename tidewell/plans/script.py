"""Scripts over DataFrames of bars: every symbol runs on its own.

A script may look at a whole symbol (higher timeframes, its last bar), so a symbol's bars
are one group of a grouped map; tables of many symbols run in parallel.
"""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import DataFrame

from tidewell.plans.interpreter import PRICES, Bars, Handle, Program, Record
from tidewell.plans.lower import lower

EMPTY = {c: [] for c in (*PRICES, "time")}


def plots_of(source: str, inputs: dict | None = None, chart_tf: str = "D") -> list[dict]:
    """kind, title and static settings of what a script draws, in the order of its calls; compiles the script."""
    program = Program(source, Bars.of(EMPTY), inputs, chart_tf)
    return [{"slot": i, "kind": p["kind"], "title": p["title"], **{k: v for k, v in p["meta"].items() if v is not None}} for i, p in enumerate(program.plots)]


def _bars(pdf: pd.DataFrame) -> Bars:
    return Bars(*[pdf[c].astype(float).tolist() for c in PRICES], pdf["time_ms"].astype("int64").tolist())


def _number(x):
    return None if x is None or isinstance(x, str | list | dict | Record | Handle) or x != x else float(x)


def _json(x):
    if isinstance(x, Record):
        x = x.f
    if isinstance(x, Handle):
        x = {"kind": x.kind, "id": x.id}
    if isinstance(x, dict):
        return {str(k): _json(v) for k, v in x.items()}
    if isinstance(x, list | tuple):
        return [_json(v) for v in x]
    return None if isinstance(x, float) and not math.isfinite(x) else x


def _grouped(bars: DataFrame, schema: str, f) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return f(pdf.sort_values("bar_index"))

    return bars.groupBy("symbol").applyInPandas(run, schema)


def run(bars: DataFrame, source: str, inputs: dict | None = None, chart_tf: str = "D") -> DataFrame:
    """symbol, bar_index, time_ms, a double column per plot (plot_0, plot_1, ...), colors per plot (map of slot to color), and vars: each ``var`` variable as JSON text."""
    n = len(plots_of(source, inputs, chart_tf))
    schema = "symbol string, bar_index long, time_ms long, " + "".join(f"plot_{i} double, " for i in range(n)) + "colors map<int,string>, vars map<string,string>"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        program = Program(source, _bars(pdf), inputs, chart_tf)
        shown = []
        for _ in range(len(pdf)):
            program.step()
            shown.append({k: json.dumps(_json(v)) for k, v in program.kept().items()})
        out = _plotted(pdf, program)
        out["colors"] = [{i: p["colors"][k] for i, p in enumerate(program.plots) if k < len(p["colors"]) and p["colors"][k] is not None} for k in range(len(pdf))]
        out["vars"] = shown
        return out

    return _grouped(bars, schema, one)


def _plotted(pdf: pd.DataFrame, program: Program) -> pd.DataFrame:
    out = pdf[["symbol", "bar_index", "time_ms"]].copy()
    for i, p in enumerate(program.plots):
        values = p["values"] + [math.nan] * (len(pdf) - len(p["values"]))
        out[f"plot_{i}"] = pd.array([_number(v) for v in values], dtype="Float64")
    return out


def plots(bars: DataFrame, source: str, inputs: dict | None = None, chart_tf: str = "D", lowered: bool = True) -> DataFrame:
    """symbol, bar_index, time_ms and a double column per plot, as in ``run``.

    A script of value functions, windows and running totals becomes columns (``lower``);
    one whose plots need more runs bar by bar, and so do all if ``lowered`` is false.
    """
    n = len(plots_of(source, inputs, chart_tf))
    if lowered and (out := lower(bars, source, inputs)) is not None:
        return out

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return _plotted(pdf, Program(source, _bars(pdf), inputs, chart_tf).run(snapshots=False))

    return _grouped(bars, "symbol string, bar_index long, time_ms long" + "".join(f", plot_{i} double" for i in range(n)), one)


def final(bars: DataFrame, source: str, inputs: dict | None = None, chart_tf: str = "D") -> DataFrame:
    """symbol, name and value (JSON) of each ``var`` variable after the last bar."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        kept = Program(source, _bars(pdf), inputs, chart_tf).run(snapshots=False).kept()
        return pd.DataFrame([(pdf["symbol"].iloc[0], k, json.dumps(_json(v))) for k, v in kept.items()], columns=["symbol", "name", "value"])

    return _grouped(bars, "symbol string, name string, value string", one)


def drawings(bars: DataFrame, source: str, inputs: dict | None = None, chart_tf: str = "D") -> DataFrame:
    """symbol, bar_index of creation, kind, id and final state (JSON) of every drawing."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        program = Program(source, _bars(pdf), inputs, chart_tf).run(snapshots=False)
        return pd.DataFrame([(pdf["symbol"].iloc[0], d.bar, d.kind, d.id, json.dumps(_json(d.state))) for d in program.drawings], columns=["symbol", "bar_index", "kind", "id", "state"])

    return _grouped(bars, "symbol string, bar_index long, kind string, id long, state string", one)


TRADE = {"entry_id": "string", "exit_id": "string", "entry_comment": "string", "exit_comment": "string", "entry_price": "double", "exit_price": "double", "entry_bar_index": "long", "exit_bar_index": "long", "size": "double", "profit": "double", "profit_percent": "double", "max_runup": "double", "max_drawdown": "double"}


def trades(bars: DataFrame, source: str, inputs: dict | None = None, chart_tf: str = "D") -> DataFrame:
    """symbol, trade (from 0) and the closed trades of a strategy."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        broker = Program(source, _bars(pdf), inputs, chart_tf).run(snapshots=False).broker
        rows = [(pdf["symbol"].iloc[0], i, *[getattr(t, k) for k in TRADE]) for i, t in enumerate(broker.trades if broker else [])]
        return pd.DataFrame(rows, columns=["symbol", "trade", *TRADE])

    return _grouped(bars, "symbol string, trade long, " + ", ".join(f"{k} {v}" for k, v in TRADE.items()), one)


def equity(bars: DataFrame, source: str, inputs: dict | None = None, chart_tf: str = "D") -> DataFrame:
    """symbol, bar_index, position_size, equity, netprofit and openprofit at each close."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        program, rows = Program(source, _bars(pdf), inputs, chart_tf), []
        for close in pdf["close"].astype(float):
            program.step()
            b = program.use_broker()
            rows.append((b.size, b.equity(close), b.realized, b.open_profit(close)))
        out = pd.DataFrame(rows, columns=["position_size", "equity", "netprofit", "openprofit"])
        return pd.concat([pdf[["symbol", "bar_index"]].reset_index(drop=True), out], axis=1)

    return _grouped(bars, "symbol string, bar_index long, position_size double, equity double, netprofit double, openprofit double", one)


def summary(bars: DataFrame, source: str, inputs: dict | None = None, chart_tf: str = "D") -> DataFrame:
    """symbol, name, value: a strategy's figures at the last close."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        program = Program(source, _bars(pdf), inputs, chart_tf).run(snapshots=False)
        found = program.use_broker().properties(float(pdf["close"].iloc[-1]))
        rows = [(pdf["symbol"].iloc[0], k, _number(v)) for k, v in found.items() if not isinstance(v, str)]
        return pd.DataFrame(rows, columns=["symbol", "name", "value"])

    return _grouped(bars, "symbol string, name string, value double", one)


def check(texts: DataFrame, name_col: str = "path", text_col: str = "value") -> DataFrame:
    """name, ok, problem: whether each script of a table compiles (as from spark.read.text(..., wholetext=True)). ok is null where the compiler itself fails."""

    def run_(batches):
        for pdf in batches:
            rows = []
            for name, text in zip(pdf["name"], pdf["text"], strict=True):
                try:
                    Program(text or "", Bars.of(EMPTY))
                    rows.append((name, True, None))
                except (ValueError, RecursionError) as e:
                    rows.append((name, False, f"{type(e).__name__}: {e}"[:500]))
                except (KeyError, TypeError, IndexError, AttributeError) as e:
                    rows.append((name, None, f"fault of the compiler: {type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(rows, columns=["name", "ok", "problem"]).astype({"ok": "boolean"})

    return texts.selectExpr(f"`{name_col}` AS name", f"`{text_col}` AS text").mapInPandas(run_, "name string, ok boolean, problem string")
