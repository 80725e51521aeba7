"""Scripts as columns: what a script plots, as one Study, where no state goes bar by bar.

Statements are taken in order.  A name stands for a column, a constant, or a ``var`` that
waits for its one update; what cannot be said in columns makes the names it changes
unknown, and only a plot that needs such a name gives up.  Calls that advance only when
they run (in branches and loops) are never lowered.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import columns as C
from tidewell.functions import library as lib
from tidewell.operators.study import Study
from tidewell.plans.interpreter import IMPLICIT, PRICES, SILENT, TA, TA_SHORT, parts
from tidewell.plans.syntax import parse


class Beyond(Exception):
    """More than columns can say."""


@dataclasses.dataclass
class Value:
    """A column with the kind that decides how it divides: int, float, bool or text. const: what it is on every bar, where that is known."""

    column: Column
    kind: str
    const: object = None


@dataclasses.dataclass
class Waiting:
    """A ``var`` before its update."""

    start: Value
    kind: str | None


UNKNOWN = object()
CASTS = {"int": "long", "float": "double", "bool": "boolean", "text": "string"}
#: Studies by the name of the series: from the Study and the values in the order of the interpreter's parameters. "n" kinds must be constants.
STUDIES = {
    **{k: (lambda s, x, n, k=k: getattr(s, k)(x, n), "float") for k in ("sma", "wma", "hma", "variance", "dev", "median", "mode", "cog", "rci", "highest", "lowest", "range", "percentrank", "cci", "cmo", "change", "mom", "roc")},
    **{k: (lambda s, x, n, k=k: getattr(s, k)(x, n), "int") for k in ("highestbars", "lowestbars")},
    **{k: (lambda s, x, n, k=k: getattr(s, k)(x, n), "bool") for k in ("rising", "falling")},
    **{k: (lambda s, a, b, k=k: getattr(s, k)(a, b), "bool") for k in ("crossover", "crossunder", "cross")},
    **{k: (lambda s, x, k=k: getattr(s, k)(x), "float") for k in ("cum", "max", "min", "swma")},
    **{k: (lambda s, *_, k=k: getattr(s, k)(), "float") for k in ("obv", "accdist", "pvt", "wad", "wvad", "iii", "ao")},
    **{k: (lambda s, x, a, b, k=k: getattr(s, k)(x, a, b), "float") for k in ("linreg", "stdev", "percentile_nearest_rank", "percentile_linear_interpolation", "bbw", "pivothigh", "pivotlow")},
    "alma": (lambda s, x, n, a, b: s.alma(x, n, a, b), "float"),
    "vwma": (lambda s, x, v, n: s.vwma(x, n), "float"),
    "mfi": (lambda s, x, v, n: s.mfi(x, n), "float"),
    "correlation": (lambda s, a, b, n: s.correlation(a, b, n), "float"),
    "stoch": (lambda s, x, h, low, n: s.stoch(x, h, low, n), "float"),
    "wpr": (lambda s, h, low, c, n: s.wpr(n), "float"),
    "tr": (lambda s, h, low, c, on: s.tr(on), "float"),
    "barssince": (lambda s, c: s.barssince(c), "int"),
    "valuewhen": (lambda s, c, x, k: s.valuewhen(c, x, k), "float"),
    "bb": (lambda s, x, n, k: s.bb(x, n, k), "float"),
}
#: Parameters that a Study takes as plain numbers.
FIXED = {"length", "mult", "offset", "sigma", "biased", "percentage", "leftbars", "rightbars", "handle_na", "occurrence"}
UNARY = {"sqrt": C.sqrt, "log": C.log, "log10": C.log10, "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": C.asin, "acos": C.acos, "atan": F.atan, "todegrees": C.todegrees, "toradians": C.toradians}
PLOTS = {"plot", "plotshape", "plotchar", "plotarrow", "plotcandle", "plotbar", "bgcolor", "barcolor", "hline", "fill"}
CALENDAR = {"year": C.year, "month": C.month, "dayofmonth": C.dayofmonth, "dayofweek": C.dayofweek, "weekofyear": C.weekofyear, "hour": C.hour, "minute": C.minute, "second": C.second}


def lower(bars: DataFrame, source: str, inputs: dict | None = None) -> DataFrame | None:
    """symbol, bar_index, time_ms, plot_0, plot_1, ...; None if a plot cannot be said in columns."""
    made = _Lowering(bars, parse(source), inputs or {})
    try:
        return made.result()
    except Beyond:
        return None


def _assigned(node) -> set[str]:
    return {x[1][1] for x in parts(node) if isinstance(x, tuple) and x and x[0] == "set" and x[1][0] == "name"}


class _Lowering:
    def __init__(self, bars: DataFrame, tree: list, inputs: dict):
        self.study, self.tree, self.inputs = Study(bars), tree, inputs
        self.functions = {}
        for node in tree:
            if node[0] == "def":
                self.functions[node[1]] = UNKNOWN if node[1] in self.functions else node  # overloads are left to the interpreter
        self.env: dict = {}
        self.outer: dict | None = None
        self.later = self.counted(tree)
        self.outer_later: dict[str, int] = {}
        self.conditional = False
        self.depth = 0
        self.shown: list[Value | None] = []

    @staticmethod
    def counted(nodes: list) -> dict[str, int]:
        """How often each name is still assigned."""
        out: dict[str, int] = {}
        for s in nodes:
            for x in parts(s) if s[0] != "def" else ():
                if isinstance(x, tuple) and x and x[0] == "set" and x[1][0] == "name":
                    out[x[1][1]] = out.get(x[1][1], 0) + 1
        return out

    def result(self) -> DataFrame:
        if any(isinstance(x, tuple) and x[:1] == ("dot",) and x[1][:2] == ("name", "runtime") for x in parts(self.tree)):
            raise Beyond("a script that may end the run")
        for node in self.tree:
            self.statement(node)
        plots = {f"plot_{i}": F.lit(None).cast("double") if v is None else v.column.cast("double") for i, v in enumerate(self.shown)}
        return self.study.result(**plots).select("symbol", F.col("bar_index").cast("long").alias("bar_index"), F.col("time_ms").cast("long").alias("time_ms"), *plots)

    # -- statements ----------------------------------------------------------------------

    def statement(self, node) -> Value | None:
        try:
            return getattr(self, "s_" + {"tuple=": "tuple"}.get(node[0], node[0]), self.s_other)(node)
        except Beyond:
            if any(x[1][:1] == ("name",) and x[1][1] in PLOTS for x in parts(node) if isinstance(x, tuple) and x[:1] == ("call",)):
                raise
            for x in parts(node):
                if isinstance(x, tuple) and x:
                    for name in [x[3]] if x[0] == "decl" else x[1] if x[0] == "tuple=" else [x[1][1]] if x[0] == "set" and x[1][0] == "name" else []:
                        self.env[name] = UNKNOWN
            return None
        finally:
            for name, n in self.counted([node]).items():
                self.later[name] = self.later.get(name, 0) - n

    def s_other(self, node):
        raise Beyond(node[0])

    def s_skip(self, node):
        return None

    s_def = s_type = s_enum = s_skip

    def s_expr(self, node):
        return self.s_if(node[1]) if node[1][0] == "if" else self.expr(node[1])

    def s_decl(self, node):
        _, keep, kind, name, value, _ = node
        if self.conditional:
            raise Beyond("a name of a branch")
        x = self.typed(self.expr(value), kind)
        if keep:
            if x.const is None and not (value[0] == "name" and value[1] == "na"):
                x = Value(self.study.hold(F.first(self.study._of(x.column)).over(self.study.past)), x.kind)
            self.env[name] = Waiting(x, kind) if self.later.get(name, 0) else x
        else:
            self.env[name] = x if x.const is not None else self.held(x)
        return x

    def held(self, x: Value) -> Value:
        return Value(self.study.hold(x.column), x.kind)

    @staticmethod
    def typed(x: Value, kind: str | None) -> Value:
        if kind == "float" and x.kind == "int":
            return Value(x.column.cast("double"), "float", None if x.const is None else float(x.const))
        if kind not in (None, "int", "float", "bool", "string", "color"):
            raise Beyond(kind)
        return Value(x.column, "float", x.const) if kind == "float" and x.kind == "na" else x

    def s_tuple(self, node):
        xs = self.many(node[2])
        if len(xs) != len(node[1]):
            raise Beyond("values")
        for name, x in zip(node[1], xs, strict=True):
            if name != "_":
                self.env[name] = self.held(x)

    def s_set(self, node, cond: Column | None = None):
        _, target, value, _ = node
        if target[0] != "name" or target[1] not in self.env:
            raise Beyond("a field or an outer name")
        name, now = target[1], self.env[target[1]]
        if now is UNKNOWN:
            raise Beyond(name)
        if isinstance(now, Waiting):
            if self.later[name] != 1:
                raise Beyond("a var with several updates")
            self.env[name] = self.updated(name, now, value, cond)
            return self.env[name]
        x = self.typed(self.expr(value), now.kind if now.kind == "float" else None)
        if cond is not None:
            x = self.either(cond, x, now)
        self.env[name] = self.held(x)
        return self.env[name]

    def updated(self, name: str, was: Waiting, value, cond: Column | None) -> Value:
        """A var whose one update adds to it, takes an extreme with it, or replaces it."""
        on, past = F.lit(True) if cond is None else F.coalesce(cond, F.lit(False)), self.study.past
        own = ("name", name)
        call = value[0] == "call" and value[1][0] == "dot" and value[1][1][:2] == ("name", "math") and value[1][2] in ("max", "min") and len(value[2]) == 2 and not value[3] and value[1][2]
        if value[0] == "bin" and value[1] in ("+", "-") and value[2][:2] == own:
            step = self.expr(value[3])
            how = "add"
        elif call and value[2][0][:2] == own:
            step, how = self.expr(value[2][1]), call
        else:
            step, how = self.expr(value), "put"
        if step.kind == "text" and how == "add":
            raise Beyond("text")
        kind = "float" if "float" in (was.kind, was.start.kind, step.kind) else was.start.kind if step.kind == "na" else step.kind
        if kind not in CASTS or {was.start.kind, step.kind} - {kind, "na", "int"}:
            raise Beyond("values of two kinds")
        x, start = (v.column.cast(CASTS[kind]) for v in (step, was.start))
        if how == "put":
            last = F.last(F.when(on, F.struct(x.alias("x"))), ignorenulls=True).over(past)
            last = self.study.hold(last)
            return Value(self.study.hold(F.when(last.isNull(), start).otherwise(last["x"])), kind)
        x, on = self.study.hold(x), self.study.hold(on)
        lost = F.max(F.when(on & x.isNull(), F.lit(1))).over(past).isNotNull()  # na stays na
        if how == "add":
            out = start + F.coalesce(F.sum(F.when(on, x if value[1] == "+" else -x)).over(past), F.lit(0))
        else:
            own_extreme = (F.max if how == "max" else F.min)(F.when(on, x)).over(past)
            out = F.when(own_extreme.isNull(), start).when(start.isNotNull(), (F.greatest if how == "max" else F.least)(start, own_extreme))
        return Value(self.study.hold(F.when(~lost, out)), kind)

    def s_if(self, node, cond: Column | None = None):
        _, test, then, other, _ = node
        on = F.coalesce(self.truth(self.expr(test)), F.lit(False))
        on = self.study.hold(on)
        before, self.conditional = self.conditional, True
        try:
            self.branch(then, on if cond is None else cond & on)
            rest = ~on if cond is None else cond & ~on
            if other and other[0][0] == "elif":
                self.s_if(other[0][1], rest)
            else:
                self.branch(other, rest)
        finally:
            self.conditional = before

    def branch(self, nodes: list, cond: Column) -> None:
        for s in nodes:
            if s[0] == "set":
                self.s_set(s, cond)
                self.later[s[1][1]] = self.later.get(s[1][1], 0) - 1  # counted once more where the whole statement ends
            elif s[0] == "expr" and s[1][0] == "if":
                self.s_if(s[1], cond)
            elif not self.silent(s):
                raise Beyond("a branch that does more than set names")
        for name in _assigned(nodes):
            self.later[name] += sum(1 for s in nodes if s[0] == "set" and s[1][0] == "name" and s[1][1] == name)

    def silent(self, s) -> bool:
        """Statements that change nothing that is plotted."""
        if s[0] == "skip":
            return True
        full = self.dotted(s[1][1]) if s[0] == "expr" and s[1][0] == "call" else None
        return full is not None and (full in SILENT or full.partition(".")[0] in ("label", "line", "box", "table", "strategy") and "." in full)

    # -- expressions ---------------------------------------------------------------------

    def expr(self, node) -> Value:
        return getattr(self, "e_" + {"?": "choose"}.get(node[0], node[0]), self.e_other)(node)

    def e_other(self, node):
        raise Beyond(node[0])

    def e_lit(self, node):
        x = node[1]
        return Value(F.lit(x), {bool: "bool", int: "int", float: "float", str: "text"}[type(x)], x)

    def name(self, name: str) -> Value:
        for scope, later in ((self.env, {}), (self.outer or {}, self.outer_later)):
            if name in scope:
                x = scope[name]
                if x is UNKNOWN or isinstance(x, Waiting) or later.get(name, 0) > 0:
                    raise Beyond(name)
                return x
        if name in PRICES:
            return Value(F.col(name), "float")
        if name in IMPLICIT:
            o, h, low, c = (F.col(x) for x in PRICES[:4])
            return Value({"hl2": (h + low) / 2, "hlc3": (h + low + c) / 3, "ohlc4": (o + h + low + c) / 4, "hlcc4": (h + low + c + c) / 4}[name], "float")
        if name == "na":
            return Value(F.lit(None).cast("double"), "na")
        if name == "bar_index":
            return Value(F.col("bar_index").cast("long"), "int")
        if name == "time":
            return Value(F.col("time_ms"), "int")
        if name in CALENDAR:
            return Value(CALENDAR[name]("time_ms").cast("long"), "int")
        if name == "tr" or name in TA and not [p for p in TA[name][1] if not p[0].startswith("$")]:
            return self.series(name, [], [])
        raise Beyond(name)

    def e_name(self, node):
        return self.name(node[1])

    def dotted(self, node) -> str | None:
        if node[0] == "name":
            return None if node[1] in self.env else node[1]
        if node[0] == "dot" and (left := self.dotted(node[1])) is not None:
            return f"{left}.{node[2]}"
        return None

    def e_dot(self, node):
        full = self.dotted(node)
        space, _, name = (full or "").partition(".")
        if space == "math" and name in lib.MATH_CONSTANTS:
            return Value(F.lit(lib.MATH_CONSTANTS[name]), "float", lib.MATH_CONSTANTS[name])
        if space == "color" and name in lib.COLORS:
            return Value(F.lit(lib.COLORS[name]), "text", lib.COLORS[name])
        if space == "ta" and name in TA:
            return self.series(name, [], [])
        raise Beyond(full or "a field")

    def e_at(self, node):
        _, own, index, _ = node
        k = self.expr(index).const
        if type(k) is not int or k < 0:
            raise Beyond("a place that varies")
        if own[0] == "name" and self.later.get(own[1], 0) > 0:
            raise Beyond("the past of a name that is assigned further on")
        if own[0] not in ("name", "dot") and self.conditional:
            raise Beyond("the past of an expression in a branch")
        x = self.expr(own)
        if x.kind == "text":
            raise Beyond("text")
        return x if k == 0 else Value(self.study.hold(self.study.lag(self.study._of(x.column), k)), x.kind)

    @staticmethod
    def truth(x: Value) -> Column:
        return x.column if x.kind == "bool" else F.lit(False) if x.kind == "na" else (x.column != "") if x.kind == "text" else (x.column != 0)

    def e_bin(self, node):
        _, op, left, right, _ = node
        if op in ("==", "!=") and any(n[:2] == ("name", "na") for n in (left, right)):
            x = self.expr(right if left[:2] == ("name", "na") else left).column
            return Value(x.isNull() if op == "==" else x.isNotNull(), "bool")
        a, b = self.expr(left), self.expr(right)
        if op in ("and", "or"):
            x, y = self.truth(a), self.truth(b)
            return Value(x & y if op == "and" else x | y, "bool")
        if op in ("==", "!=") and a.const is not None and b.const is not None:
            same = lib.equal(a.const, b.const) == (op == "==")
            return Value(F.lit(same), "bool", same)
        if "text" in (a.kind, b.kind) or op in "+-*/%" and "bool" in (a.kind, b.kind):
            raise Beyond("text")
        whole = a.kind == b.kind == "int"
        x, y = (a.column, b.column) if whole or a.kind == b.kind == "bool" else (a.column.cast("double"), b.column.cast("double"))
        if op in ("+", "-", "*"):
            out = x + y if op == "+" else x - y if op == "-" else x * y
            known = None if a.const is None or b.const is None else a.const + b.const if op == "+" else a.const - b.const if op == "-" else a.const * b.const
            return Value(out, "int" if whole else "float", known)
        if op == "/":
            return Value(C.int_divide(x, y) if whole else C.divide(x, y), "int" if whole else "float", None if a.const is None or b.const is None else lib.divide(a.const, b.const))
        if op == "%":
            return Value(C.remainder(x, y), "int" if whole else "float")
        return Value({"==": C.equal, "!=": C.not_equal, "<": lambda u, v: u < v, "<=": lambda u, v: u <= v, ">": lambda u, v: u > v, ">=": lambda u, v: u >= v}[op](x, y), "bool")

    def e_neg(self, node):
        x = self.expr(node[1])
        if x.kind not in ("int", "float", "na"):
            raise Beyond("a sign")
        return Value(-x.column, x.kind, None if x.const is None else -x.const)

    def e_not(self, node):
        return Value(~self.truth(self.expr(node[1])), "bool")

    def either(self, cond: Column, a: Value, b: Value) -> Value:
        kinds = {a.kind, b.kind} - {"na"}
        if len(kinds) > 1 and kinds != {"int", "float"}:
            raise Beyond("values of two kinds")
        kind = "float" if len(kinds) != 1 else kinds.pop()
        own = [F.lit(None) if x.kind == "na" else x.column.cast("double") if kind == "float" else x.column for x in (a, b)]
        return Value(F.when(F.coalesce(cond, F.lit(False)), own[0]).otherwise(own[1]), kind)

    def e_choose(self, node):
        """Both sides advance on every bar, as columns do."""
        cond = self.truth(self.expr(node[1]))
        return self.either(cond, self.expr(node[2]), self.expr(node[3]))

    def value_of(self, nodes: list) -> Value:
        if not nodes:
            return self.name("na")
        if len(nodes) != 1 or nodes[0][0] not in ("expr", "elif"):
            raise Beyond("a block")
        return self.expr(nodes[0][1])

    def e_if(self, node):
        cond = self.truth(self.expr(node[1]))
        before, self.conditional = self.conditional, True
        try:
            return self.either(cond, self.value_of(node[2]), self.value_of(node[3]))
        finally:
            self.conditional = before

    def e_switch(self, node):
        subject = self.expr(node[1]) if node[1] else None
        before, self.conditional = self.conditional, True
        try:
            out = self.name("na")
            for case, body in [c for c in node[2] if c[0] is None][-1:] + [c for c in reversed(node[2]) if c[0] is not None]:
                x = self.value_of(body)
                if case is None:
                    out = x
                    continue
                test = self.expr(case)
                if subject is not None and (test.kind == "na" or "text" in (test.kind, subject.kind) and test.kind != subject.kind):
                    raise Beyond("a case of another kind")
                out = self.either(self.truth(test) if subject is None else C.equal(subject.column, test.column), x, out)
            return out
        finally:
            self.conditional = before

    def many(self, node) -> list[Value]:
        if node[0] == "list":
            return [self.expr(n) for n in node[1]]
        if node[0] == "call" and self.dotted(node[1]) == "ta.bb":
            return self.series("bb", node[2], node[3])
        raise Beyond("values")

    # -- calls -----------------------------------------------------------------------------

    def e_call(self, node):
        _, callee, args, named, _, _ = node
        if callee[0] == "name" and callee[1] in self.functions:
            return self.inlined(self.functions[callee[1]], args, named)
        full = self.dotted(callee)
        if full is None:
            raise Beyond("a method")
        space, _, name = full.partition(".")
        if full in PLOTS:
            return self.plot(full, args, dict(named))
        if full in SILENT or full == "strategy":
            return self.name("na")
        if space == "ta" and name in TA:
            return self.series(name, args, named)
        if space == "math" and (name in lib.MATH or name == "sum"):
            return self.math(name, args, named)
        if full in ("nz", "na", "fixnan", "int", "float", "bool"):
            return self.plain(full, args, named)
        if full == "input" or space == "input":
            return self.input(args, dict(named))
        raise Beyond(full)

    def inlined(self, node, args, named):
        """A script's function, where it is called on every bar."""
        if node is UNKNOWN or self.conditional or self.depth > 20:
            raise Beyond("a function")
        _, _, params, body, _, _ = node
        given = dict(zip([p for _, p, _ in params], args, strict=False)) | dict(named)
        values = {}
        for kind, param, default in params:
            if param not in given and default is None:
                raise Beyond(param)
            x = self.typed(self.expr(given.get(param, default)), kind)
            values[param] = x if x.const is not None else self.held(x)
        saved = self.env, self.outer, self.later, self.outer_later
        if self.outer is None:
            self.outer, self.outer_later = self.env, self.later
        self.env, self.later = values, self.counted(body)
        self.depth += 1
        try:
            out = None
            for i, s in enumerate(body):
                out = self.expr(s[1]) if s[0] == "expr" and i == len(body) - 1 else self.statement(s)
            if out is None:
                raise Beyond("a function without a value")
            return out
        finally:
            self.env, self.outer, self.later, self.outer_later = saved
            self.depth -= 1

    def series(self, name, args, named):
        if name not in STUDIES or self.conditional:
            raise Beyond(f"ta.{name}")
        params = TA[name][1]
        shown = [p for p in params if not p[0].startswith("$")]
        if name in TA_SHORT and len(args) == TA_SHORT[name] and "source" not in dict(named) and len(args) + len(named) < len(shown):
            shown = shown[1:]
        if len(args) > len(shown):
            raise Beyond("arguments")
        given = dict(zip([p for p, _ in shown], args, strict=False))
        for key, a in named:
            given[key if any(key == p for p, _ in params) else {"source": "series", "series": "source", "bars": "length"}.get(key, key)] = a
        values = []
        for p, default in params:
            x = self.expr(given[p]) if p in given else None
            if p in FIXED:
                k = x.const if x is not None else default
                if type(k) not in (int, float, bool) or p in ("length", "leftbars", "rightbars", "occurrence") and (type(k) is not int or k < (p == "length")):
                    raise Beyond(f"{p} that varies")
                values.append(k)
            elif x is not None:
                if x.kind == "text":
                    raise Beyond("text")
                values.append(self.truth(x) if p == "condition" else x.column if name == "valuewhen" or x.kind not in ("int", "na") else x.column.cast("double"))
            elif isinstance(default, str):
                values.append(F.col(default[1:]) if default[1:] in PRICES else self.name(default[1:]).column)
            else:
                raise Beyond(p)
        made, kind = STUDIES[name]
        if name == "cum":
            kind = "float"
        out = made(self.study, *values)
        if isinstance(out, tuple):
            return [Value(self.study.hold(x), kind) for x in out]
        return Value(self.study.hold(out.cast("long") if kind == "int" else out), kind)

    def math(self, name, args, named):
        if named and not (name == "sum" and not args):
            raise Beyond("named arguments")
        if name == "sum":
            own = dict(zip(("source", "length"), args, strict=False)) | dict(named)
            n = self.expr(own["length"]).const
            if type(n) is not int or n < 1 or self.conditional:
                raise Beyond("math.sum")
            return Value(self.study.hold(self.study.sum(self.expr(own["source"]).column.cast("double"), n)), "float")
        xs = [self.expr(a) for a in args]
        if any(x.kind not in ("int", "float", "na") for x in xs):
            raise Beyond("math of another kind")
        whole, cols = all(x.kind == "int" for x in xs), [x.column for x in xs]
        d = [c.cast("double") for c in cols]
        if name in ("max", "min") and len(xs) > 1:
            return Value((C.maximum if name == "max" else C.minimum)(*(cols if whole else d)), "int" if whole else "float")
        if name == "abs":
            return Value(F.abs(cols[0]), xs[0].kind)
        if name == "avg":
            return Value(C.average(*d), "float")
        if name == "round" and len(xs) == 1:
            return Value(C.rounded(d[0]), "float")
        if name == "round" and type(xs[1].const) is int:
            return Value(C.rounded(d[0], xs[1].const), "float")
        if name in ("floor", "ceil"):
            return Value((F.floor if name == "floor" else F.ceil)(d[0]).cast("long"), "int")
        if name == "sign":
            return Value(F.signum(d[0]).cast("long"), "int")
        if name == "pow" and not whole:
            return Value(C.power(*d), "float")
        if name in UNARY and len(xs) == 1:
            return Value(UNARY[name](d[0]), "float")
        raise Beyond(f"math.{name}")

    def plain(self, name, args, named):
        x = self.expr(args[0] if args else named[0][1])
        if name == "na":
            return Value(x.column.isNull(), "bool")
        if name == "nz":
            r = self.expr(args[1]) if len(args) > 1 else self.expr(dict(named)["replacement"]) if "replacement" in dict(named) else Value(F.lit(0), "int", 0)
            if "text" in (x.kind, r.kind) or "bool" in (x.kind, r.kind):
                raise Beyond("nz of another kind")
            kind = "int" if x.kind == r.kind == "int" else "float"
            return Value(F.coalesce(*[v.column.cast("double") if kind == "float" else v.column for v in (x, r)]), kind)
        if name == "fixnan":
            if self.conditional:
                raise Beyond("fixnan in a branch")
            return Value(self.study.hold(self.study.fixnan(x.column)), x.kind)
        if x.kind == "text":
            raise Beyond("text")
        if name == "bool":
            return Value(F.coalesce(self.truth(x), F.lit(False)), "bool")
        if name == "float":
            return Value(x.column.cast("double"), "float", None if x.const is None else float(x.const))
        return Value(x.column.cast("long"), "int", None if x.const is None else int(x.const))

    def input(self, args, named):
        default = args[0] if args else named.get("defval")
        title = args[1] if len(args) > 1 else named.get("title")
        key = title[1] if title is not None and title[0] == "lit" else None
        if key is not None and key in self.inputs:
            x = self.inputs[key]
            if isinstance(x, str) and x in (*PRICES, *IMPLICIT):
                return self.name(x)
            return self.e_lit(("lit", x))
        if default is None:
            return self.name("na")
        return self.expr(default)

    def plot(self, kind, args, named):
        if self.conditional or self.outer is not None:
            raise Beyond("a plot in a branch or function")
        x = None
        if kind in ("plot", "plotarrow", "hline", "plotshape", "plotchar"):
            x = self.expr(args[0] if args else named["price" if kind == "hline" else "series"])
            if kind in ("plotshape", "plotchar"):
                x = Value(F.coalesce(self.truth(x), F.lit(False)), "bool")
            if x.kind == "text":
                x = None
        self.shown.append(x)
        slot = len(self.shown) - 1
        return Value(F.lit(slot), "int", slot)
