"""The value functions as Column expressions, with na as NULL.

What Spark's own functions can say stays in the JVM; number formats, session strings and
linear algebra run the plain functions of ``library`` over Arrow batches.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions import library as lib


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def sane(x: Column) -> Column:
    """NaN as NULL."""
    return F.when(~F.isnan(x), x)


def all_there(*xs) -> Column:
    out = _c(xs[0]).isNotNull()
    for x in xs[1:]:
        out = out & _c(x).isNotNull()
    return out


# -- operators ----------------------------------------------------------------------------


def divide(a, b) -> Column:
    return _c(a) / F.nullif(_c(b), F.lit(0).cast("double"))


def int_divide(a, b) -> Column:
    """Whole numbers, towards zero."""
    a, safe = _c(a).cast("long"), F.nullif(_c(b).cast("long"), F.lit(0).cast("long"))
    return ((a - a % safe) / safe).cast("long")


def remainder(a, b) -> Column:
    """With the dividend's sign."""
    return _c(a) % F.nullif(_c(b), F.lit(0))


def equal(a, b) -> Column:
    """Never na: false if either is."""
    return F.coalesce(_c(a) == _c(b), F.lit(False))


def not_equal(a, b) -> Column:
    return ~equal(a, b)


def choose(cond, a, b) -> Column:
    return F.when(F.coalesce(_c(cond), F.lit(False)), _c(a)).otherwise(_c(b))


def nz(x, r=0) -> Column:
    return F.coalesce(_c(x), _c(r))


def na(x) -> Column:
    return _c(x).isNull()


def to_int(x) -> Column:
    return _c(x).cast("long")


def to_bool(x) -> Column:
    return F.coalesce(_c(x) != 0, F.lit(False))


# -- math.* -------------------------------------------------------------------------------


def maximum(*xs) -> Column:
    return F.when(all_there(*xs), F.greatest(*map(_c, xs)))


def minimum(*xs) -> Column:
    return F.when(all_there(*xs), F.least(*map(_c, xs)))


def average(*xs) -> Column:
    own = F.filter(F.array(*[_c(x).cast("double") for x in xs]), lambda v: v.isNotNull())
    return F.aggregate(own, F.lit(0.0), lambda a, b: a + b) / F.nullif(F.size(own), F.lit(0))


def rounded(x, places: int = 0) -> Column:
    """Half away from zero."""
    k = F.lit(10.0**places)
    return F.signum(_c(x)) * F.floor(F.abs(_c(x)) * k + 0.5) / k


def to_tick(x, tick: float = 0.01) -> Column:
    return _c(x) if tick <= 0 else rounded(_c(x) / F.lit(tick)) * F.lit(tick)


def clamp(x, low, high) -> Column:
    return F.when(all_there(x, low, high), F.least(F.greatest(_c(x), _c(low)), _c(high)))


def _checked(f):
    return lambda x: sane(f(_c(x)))


sqrt, asin, acos = _checked(F.sqrt), _checked(F.asin), _checked(F.acos)
log = lambda x: F.when(_c(x) > 0, F.ln(_c(x)))
log10 = lambda x: F.when(_c(x) > 0, F.log10(_c(x)))
todegrees = lambda x: _c(x) * 180 / math.pi
toradians = lambda x: _c(x) * math.pi / 180
power = lambda a, b: sane(F.pow(_c(a), _c(b)))

# -- str.* --------------------------------------------------------------------------------

length = lambda s: F.coalesce(F.char_length(_c(s)), F.lit(0))
pos = lambda s, t: F.instr(_c(s), t) - 1
trim = lambda s: F.regexp_replace(_c(s), r"^[\s ]+|[\s ]+$", "")


def substring(s, begin: int, end: int = -1) -> Column:
    size = F.lit(2**31 - 1) if end < 0 else F.lit(max(0, end - begin))
    return F.substring(_c(s), F.lit(begin + 1), size)


def repeat(s, n: int, sep: str = "") -> Column:
    return F.when(_c(s).isNotNull(), F.array_join(F.array_repeat(_c(s), max(0, n)), sep))


def replace_nth(s, target: str, new: str, k: int = 0) -> Column:
    """The k-th occurrence, from 1; 0 is the first."""
    k = max(1, k)
    parts = F.split(_c(s), r"\Q" + target + r"\E", -1)
    head, tail = F.array_join(F.slice(parts, 1, k), target), F.array_join(F.slice(parts, k + 1, F.greatest(F.size(parts), F.lit(k + 1))), target)
    return F.when(F.size(parts) > k, F.concat(head, F.lit(new), tail)).otherwise(_c(s))


def split(s, sep: str) -> Column:
    return F.split(_c(s), r"\Q" + sep + r"\E", -1) if sep else F.lit(None).cast("array<string>")


def match(s, pattern: str) -> Column:
    return F.regexp_extract(_c(s), f"({pattern})", 1)


def tonumber(s) -> Column:
    return F.when(F.trim(_c(s)).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.trim(_c(s)).try_cast("double"))


def _udf(f, kind: str, *fixed):
    """A library function over columns, in Arrow batches; na in is NaN, na out NULL."""

    def one(*args):
        out = f(*args, *fixed)
        return None if isinstance(out, float) and math.isnan(out) else out

    @F.pandas_udf(kind)
    def run(*cols: pd.Series) -> pd.Series:
        return pd.Series([one(*[a if not (isinstance(a, float) and math.isnan(a)) else math.nan for a in row]) for row in zip(*cols, strict=True)], dtype=object)

    return lambda *xs: run(*map(_c, xs))


def tostring(x, form: str = "") -> Column:
    return _udf(lib.tostring, "string", form)(x)


def format_number(x, pattern: str = "") -> Column:
    return _udf(lib.format_number, "string", pattern)(x)


def format_time(ms, form: str = "yyyy-MM-dd'T'HH:mm:ssZ") -> Column:
    return _udf(lib.format_time, "string", form)(ms)


def format_text(template: str, *xs) -> Column:
    return _udf(lambda *a: lib.format_text(template, *a), "string")(*xs)


# -- time ---------------------------------------------------------------------------------


def _local(ms, tz: str | None) -> Column:
    t = F.timestamp_millis(_c(ms))
    return F.from_utc_timestamp(t, tz) if tz else t


def _field(f):
    return lambda ms, tz=None: F.when(_c(ms) == 0, F.lit(0)).otherwise(f(_local(ms, tz))).cast("int")


year, month, dayofmonth, dayofweek, hour, minute, second, weekofyear = map(_field, (F.year, F.month, F.dayofmonth, F.dayofweek, F.hour, F.minute, F.second, F.weekofyear))


def timestamp(y, mo, d, h=0, mi=0, s=0) -> Column:
    """Epoch ms; days and less may overflow."""
    months = _c(y) * 12 + _c(mo) - 1
    first = F.make_date(F.floor(months / 12).cast("int"), (F.pmod(months, F.lit(12)) + 1).cast("int"), F.lit(1))
    return (F.unix_date(first).cast("long") + _c(d) - 1) * lib.DAY + _c(h) * 3_600_000 + _c(mi) * 60_000 + _c(s) * 1000


def period_start(ms, tf: str) -> Column:
    minutes = lib.timeframe_minutes(tf)
    t = F.timestamp_millis(_c(ms))
    if minutes in (10080, 43200):
        return F.unix_millis(F.date_trunc("week" if minutes == 10080 else "month", t))
    size = int(minutes * 60_000)
    return F.floor(_c(ms) / size).cast("long") * size


def period_end(ms, tf: str) -> Column:
    if lib.timeframe_minutes(tf) == 43200:
        return F.unix_millis(F.date_trunc("month", F.timestamp_millis(_c(ms))) + F.expr("INTERVAL 1 MONTH"))
    return period_start(ms, tf) + int(lib.timeframe_minutes(tf) * 60_000)


def in_session(ms, session: str) -> Column:
    """HHMM-HHMM[,...][:days], overnight ranges too."""
    found = lib.session_ranges(session)
    if found is None:
        return F.lit(True)
    t = F.timestamp_millis(_c(ms))
    at, day = F.hour(t) * 60 + F.minute(t), F.dayofweek(t)
    ranges, days = found
    out = F.lit(False)
    for a, b in ranges:
        if a < b:
            out = out | ((at >= a) & (at < b) & day.isin(*days))
        else:
            out = out | ((at >= a) & day.isin(*days)) | ((at < b) & F.pmod(day - 2, F.lit(7)).isin(*[x - 1 for x in days]))
    return out


# -- arrays -------------------------------------------------------------------------------


def kept(a) -> Column:
    return F.filter(_c(a), lambda v: v.isNotNull() & ~F.isnan(v))


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def get(a, i) -> Column:
    return F.when(_c(i) >= 0, F.try_element_at(_c(a), (_c(i) + 1).cast("int")))


def array_sum(a) -> Column:
    return _total(F.transform(kept(a), lambda v: v.cast("double")))


def array_avg(a) -> Column:
    return array_sum(a) / F.nullif(F.size(kept(a)), F.lit(0))


def array_nth(a, k: int = 0, top: bool = True) -> Column:
    s = F.array_sort(kept(a))
    s = F.reverse(s) if top else s
    return F.get(s, F.lit(k))


def array_range(a) -> Column:
    return F.array_max(kept(a)) - F.array_min(kept(a))


def array_median(a) -> Column:
    s = F.array_sort(kept(a))
    n = F.size(s)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def let(value: Column, f) -> Column:
    """f(value), with value computed once: lambdas would compute it for every element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _mean(a: Column) -> Column:
    return _total(a) / F.nullif(F.size(a), F.lit(0))


def array_variance(a) -> Column:
    def of(k: Column) -> Column:
        return let(_mean(k), lambda m: F.when(F.size(k) >= 2, _mean(F.transform(k, lambda v: (v - m) * (v - m)))))

    return let(F.transform(kept(a), lambda v: v.cast("double")), of)


def array_stdev(a) -> Column:
    return F.sqrt(array_variance(a))


def array_covariance(a, b) -> Column:
    pairs = F.filter(F.zip_with(_c(a), _c(b), lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))), lambda p: p["x"].isNotNull() & p["y"].isNotNull())

    def of(p: Column) -> Column:
        x, y = F.transform(p, lambda q: q["x"]), F.transform(p, lambda q: q["y"])
        return let(F.struct(_mean(x).alias("x"), _mean(y).alias("y")), lambda m: _mean(F.transform(p, lambda q: (q["x"] - m["x"]) * (q["y"] - m["y"]))))

    return let(pairs, of)


def array_standardize(a) -> Column:
    return let(F.struct(array_avg(a).alias("m"), array_stdev(a).alias("d")), lambda s: F.transform(_c(a), lambda v: F.when(s["d"] == 0, F.lit(1.0)).otherwise((v - s["m"]) / F.nullif(s["d"], F.lit(0.0)))))


def array_percentile_nearest_rank(a, p: float) -> Column:
    s = F.array_sort(kept(a))
    return F.get(s, F.greatest(F.lit(0), F.least(F.size(s) - 1, F.ceil(F.lit(p / 100) * F.size(s)).cast("int") - 1)))


def array_percentile_linear(a, p: float) -> Column:
    s = F.array_sort(kept(a))
    r = F.lit(p / 100) * (F.size(s) - 1)
    i = F.floor(r).cast("int")
    x = F.get(s, i)
    return x + (F.get(s, F.least(i + 1, F.size(s) - 1)) - x) * (r - i)


def array_percentrank(a, v) -> Column:
    return 100.0 * F.size(F.filter(kept(a), lambda x: x < _c(v))) / F.nullif(F.size(kept(a)), F.lit(0))


def array_mode(a) -> Column:
    """The first seen of the commonest."""

    def of(k: Column) -> Column:
        return F.array_min(F.transform(F.array_distinct(k), lambda v: F.struct((-F.size(F.filter(k, lambda u: u == v))).alias("n"), F.array_position(k, v).alias("at"), v.alias("v"))))["v"]

    return let(kept(a), of)


def index_of(a, v) -> Column:
    return F.array_position(_c(a), v) - 1


def last_index_of(a, v) -> Column:
    at = F.array_position(F.reverse(_c(a)), v)
    return F.when(at > 0, F.size(_c(a)) - at).otherwise(F.lit(-1))


def binary_search(a, v, side: str = "") -> Column:
    """In a sorted array: the exact index or -1; leftmost and rightmost give the places of insertion."""
    below, upto = F.size(F.filter(_c(a), lambda x: x < v)), F.size(F.filter(_c(a), lambda x: x <= v))
    there = upto > below
    if side:
        return below if side == "leftmost" else upto
    return F.when(there, below).otherwise(F.lit(-1))


def sort_indices(a, descending: bool = False) -> Column:
    """Stable, na last."""
    pairs = F.transform(_c(a), lambda v, i: F.struct(v.isNull().alias("z"), ((-v) if descending else v).alias("v"), i.alias("i")))
    return F.transform(F.array_sort(pairs), lambda p: p["i"])


def array_sort(a, descending: bool = False) -> Column:
    own = F.array_sort(kept(a))
    return F.concat(F.reverse(own) if descending else own, F.filter(_c(a), lambda v: v.isNull()))


def array_slice(a, start: int, end: int = -1) -> Column:
    size = F.size(_c(a)) if end < 0 else F.least(F.lit(end), F.size(_c(a)))
    return F.slice(_c(a), F.lit(start + 1), F.greatest(size - start, F.lit(0)))


def array_new(n: int, v=None) -> Column:
    return F.array_repeat(_c(v) if v is not None else F.lit(None).cast("double"), max(0, n))


def array_set(a, i: int, v) -> Column:
    """Places that are not there change nothing."""
    return F.transform(_c(a), lambda x, k: F.when(k == i, _c(v)).otherwise(x))


def array_fill(a, v, start: int = 0, end: int = -1) -> Column:
    return F.transform(_c(a), lambda x, k: F.when((k >= start) & (F.lit(end < 0) | (k < end)), _c(v)).otherwise(x))


def array_push(a, v) -> Column:
    return F.concat(_c(a), F.array(_c(v)))


def array_unshift(a, v) -> Column:
    return F.concat(F.array(_c(v)), _c(a))


def array_insert(a, i: int, v) -> Column:
    return F.concat(F.slice(_c(a), 1, i), F.array(_c(v)), F.slice(_c(a), i + 1, F.greatest(F.size(_c(a)) - i, F.lit(0))))


def array_without(a, i: int) -> Column:
    """The array after the i-th element was removed; remove, pop (i = -1) and shift (0) return ``get`` of it."""
    at = F.size(_c(a)) - 1 if i < 0 else F.lit(i)
    return F.filter(_c(a), lambda _, k: k != at)


def array_abs(a) -> Column:
    return F.transform(_c(a), F.abs)


def every(a) -> Column:
    return F.forall(_c(a), lambda v: F.coalesce(v != 0, F.lit(False)))


def some(a) -> Column:
    return F.exists(_c(a), lambda v: F.coalesce(v != 0, F.lit(False)))


# -- maps ---------------------------------------------------------------------------------


def map_get(m, k, default=None) -> Column:
    return F.coalesce(F.try_element_at(_c(m), _c(k)), _c(default)) if default is not None else F.try_element_at(_c(m), _c(k))


def map_contains(m, k) -> Column:
    return F.coalesce(F.map_contains_key(_c(m), _c(k)), F.lit(False))


def map_put(m, k, v) -> Column:
    """A map with the key set; order of first appearance stays."""
    held = F.transform(F.map_entries(_c(m)), lambda e: F.struct(e["key"].alias("key"), F.when(e["key"] == _c(k), _c(v)).otherwise(e["value"]).alias("value")))
    new = F.array(F.struct(_c(k).alias("key"), _c(v).alias("value")))
    return F.map_from_entries(F.when(map_contains(m, k), held).otherwise(F.concat(held, new)))


def map_remove(m, k) -> Column:
    return F.map_filter(_c(m), lambda key, _: key != _c(k))


def map_put_all(m, other) -> Column:
    """Keys of both; the other's values win, and its new keys come last."""
    held = F.transform(F.map_entries(_c(m)), lambda e: F.struct(e["key"].alias("key"), F.coalesce(F.try_element_at(_c(other), e["key"]), e["value"]).alias("value")))
    new = F.filter(F.map_entries(_c(other)), lambda e: ~F.map_contains_key(_c(m), e["key"]))
    return F.map_from_entries(F.concat(held, new))


map_keys, map_values, map_size = (lambda m: F.map_keys(_c(m))), (lambda m: F.map_values(_c(m))), (lambda m: F.size(_c(m)))

# -- matrices: arrays of rows ---------------------------------------------------------------


def transpose(m) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(F.get(_c(m), F.lit(0))) - 1), lambda j: F.transform(_c(m), lambda row: F.get(row, j.cast("int"))))


def mult(a, b) -> Column:
    right = transpose(b)
    return F.transform(_c(a), lambda row: F.transform(right, lambda c: _total(F.zip_with(row, c, lambda x, y: x * y))))


def trace(m) -> Column:
    n = F.least(F.size(_c(m)), F.size(F.get(_c(m), F.lit(0))))
    return _total(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(F.get(_c(m), i.cast("int")), i.cast("int"))))


def cells(m) -> Column:
    """All cells, row by row."""
    return F.flatten(_c(m))


def matrix_new(rows: int, cols: int, v) -> Column:
    return F.array_repeat(F.array_repeat(_c(v), cols), rows)


def matrix_row(m, i: int) -> Column:
    return F.get(_c(m), F.lit(i))


def matrix_col(m, j: int) -> Column:
    return F.transform(_c(m), lambda row: F.get(row, F.lit(j)))


def matrix_set(m, i: int, j: int, v) -> Column:
    return F.transform(_c(m), lambda row, k: F.when(k == i, F.transform(row, lambda x, c: F.when(c == j, _c(v)).otherwise(x))).otherwise(row))


def matrix_add_row(m, values, i: int | None = None) -> Column:
    return array_push(m, values) if i is None else array_insert(m, i, values)


def matrix_add_col(m, values, j: int | None = None) -> Column:
    return F.zip_with(_c(m), _c(values), lambda row, v: array_push(row, v) if j is None else array_insert(row, j, v))


def matrix_without_row(m, i: int = -1) -> Column:
    return array_without(m, i)


def matrix_without_col(m, j: int = -1) -> Column:
    return F.transform(_c(m), lambda row: array_without(row, j))


def matrix_swap_rows(m, a: int, b: int) -> Column:
    return F.transform(_c(m), lambda row, k: F.when(k == a, F.get(_c(m), F.lit(b))).when(k == b, F.get(_c(m), F.lit(a))).otherwise(row))


def matrix_swap_columns(m, a: int, b: int) -> Column:
    return F.transform(_c(m), lambda row: F.transform(row, lambda x, k: F.when(k == a, F.get(row, F.lit(b))).when(k == b, F.get(row, F.lit(a))).otherwise(x)))


def submatrix(m, r0: int = 0, r1: int = -1, c0: int = 0, c1: int = -1) -> Column:
    return F.transform(array_slice(m, r0, r1), lambda row: array_slice(row, c0, c1))


def matrix_concat(a, b, by_columns: bool = False) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: F.concat(x, y)) if by_columns else F.concat(_c(a), _c(b))


def reshape(m, rows: int, cols: int) -> Column:
    return F.array(*[F.slice(cells(m), i * cols + 1, cols) for i in range(rows)])


def matrix_sort(m, col: int = 0, descending: bool = False) -> Column:
    """Rows by a column; equal ones keep their order."""
    keyed = F.transform(_c(m), lambda row, k: F.struct((-F.get(row, F.lit(col)) if descending else F.get(row, F.lit(col))).alias("v"), k.alias("k"), row.alias("row")))
    return F.transform(F.array_sort(keyed), lambda x: x["row"])


def matrix_plus(a, b, sign: int = 1) -> Column:
    """Cell by cell, of a matrix or number."""
    if not isinstance(b, Column | str):
        return F.transform(_c(a), lambda row: F.transform(row, lambda x: x + sign * F.lit(b)))
    return F.zip_with(_c(a), _c(b), lambda x, y: F.zip_with(x, y, lambda u, v: u + sign * v))


def matrix_mode(m) -> Column:
    """The least of the commonest."""
    return let(kept(cells(m)), lambda k: F.array_min(F.transform(F.array_distinct(k), lambda v: F.struct((-F.size(F.filter(k, lambda u: u == v))).alias("n"), v.alias("v"))))["v"])


def row_steps(m) -> Column:
    return F.zip_with(F.slice(_c(m), 1, F.size(_c(m)) - 1), F.slice(_c(m), 2, F.size(_c(m)) - 1), lambda a, b: F.zip_with(a, b, lambda x, y: y - x))


def _rows(m):
    return None if m is None else lib.Matrix([list(map(float, r)) for r in m])


def _of_matrix(name: str, kind: str, plain=lambda x: x):
    f = lib.MATRICES[name]

    def run(ms: pd.Series) -> pd.Series:
        out = []
        for m in ms:
            x = f(_rows(m)) if m is not None else None
            out.append(None if x is None or (isinstance(x, float) and math.isnan(x)) else plain(x))
        return pd.Series(out, dtype=object)

    return lambda m: F.pandas_udf(run, kind)(_c(m))


_LISTS = lambda x: [list(map(float, r)) for r in x]
det = _of_matrix("det", "double")
rank = _of_matrix("rank", "long")
inverse = _of_matrix("inv", "array<array<double>>", _LISTS)
pseudo_inverse = _of_matrix("pinv", "array<array<double>>", _LISTS)
eigenvalues = _of_matrix("eigenvalues", "array<double>", lambda x: list(map(float, x)))
eigenvectors = _of_matrix("eigenvectors", "array<array<double>>", _LISTS)


def _square(m: Column) -> Column:
    return F.forall(m, lambda row: F.size(row) == F.size(m))


def _cells_pass(test):
    """Whether test(i, j, x) holds for all cells, na as 0."""
    return lambda m: F.forall(F.transform(m, lambda row, i: F.forall(F.transform(row, lambda x, j: test(i, j, F.coalesce(x, F.lit(0.0)))), lambda ok: ok)), lambda ok: ok)


def _near(x: Column) -> Column:
    return F.abs(x) <= lib.EPS


def _mirrored(sign: int):
    return lambda m: _square(m) & F.forall(F.transform(m, lambda row, i: F.forall(F.transform(row, lambda x, j: _near(x + sign * F.get(F.get(m, j.cast("int")), i.cast("int")))), lambda ok: F.coalesce(ok, F.lit(False)))), lambda ok: ok)


_TESTS = {
    "is_square": _square,
    "is_symmetric": _mirrored(-1),
    "is_antisymmetric": _mirrored(1),
    "is_diagonal": lambda m: _square(m) & _cells_pass(lambda i, j, x: (i == j) | _near(x))(m),
    "is_antidiagonal": lambda m: _square(m) & _cells_pass(lambda i, j, x: (i + j == F.size(m) - 1) | _near(x))(m),
    "is_identity": lambda m: _square(m) & _cells_pass(lambda i, j, x: _near(x - (i == j).cast("double")))(m),
    "is_triangular": lambda m: _square(m) & (_cells_pass(lambda i, j, x: (j >= i) | _near(x))(m) | _cells_pass(lambda i, j, x: (j <= i) | _near(x))(m)),
    "is_stochastic": lambda m: F.forall(m, lambda row: F.forall(row, lambda x: x >= -lib.EPS) & _near(_total(F.transform(row, lambda x: x.cast("double"))) - 1)),
    "is_binary": _cells_pass(lambda i, j, x: (x == 0) | (x == 1)),
    "is_zero": _cells_pass(lambda i, j, x: _near(x)),
}
matrix_tests = {name: (lambda m, test=test: test(_c(m))) for name, test in _TESTS.items()}


def matrix_power(m, k: int) -> Column:
    @F.pandas_udf("array<array<double>>")
    def run(ms: pd.Series) -> pd.Series:
        return pd.Series([None if (x := lib.power(_rows(m), k)) is None else _LISTS(x) for m in ms], dtype=object)

    return run(_c(m))


def kron(a, b) -> Column:
    return F.flatten(F.transform(_c(a), lambda ra: F.transform(_c(b), lambda rb: F.flatten(F.transform(ra, lambda x: F.transform(rb, lambda y: x * y))))))


# -- colors ---------------------------------------------------------------------------------


def rgb(r, g, b, transp=None) -> Column:
    hexed = F.concat(F.lit("#"), *[F.lpad(F.hex(F.least(F.greatest(_c(x).cast("long"), F.lit(0)), F.lit(255))), 2, "0") for x in (r, g, b)])
    return hexed if transp is None else F.concat(hexed, _alpha(transp))


def _alpha(transp) -> Column:
    t = _c(transp)
    return F.when(t == 0, F.lit("")).otherwise(F.lpad(F.hex((255 * (1 - t / 100)).cast("long")), 2, "0"))


def with_transparency(c, transp) -> Column:
    return F.concat(F.substring(_c(c), 1, 7), _alpha(transp))


def channel(c, k: int) -> Column:
    """Red, green, blue, or transparency (3)."""
    part = F.conv(F.substring(_c(c), 2 + 2 * k, 2), 16, 10).cast("double")
    return part if k < 3 else F.when(F.length(_c(c)) > 7, 100 * (1 - part / 255)).otherwise(F.lit(0.0))


def gradient(x, low, high, a: str, b: str) -> Column:
    k = F.least(F.lit(1.0), F.greatest(F.lit(0.0), divide(_c(x) - _c(low), _c(high) - _c(low))))
    parts = [F.lpad(F.hex((F.lit(float(lib.channel(a, i))) + (lib.channel(b, i) - lib.channel(a, i)) * k).cast("long")), 2, "0") for i in range(3)]
    return F.when(_c(x).isNotNull(), F.concat(F.lit("#"), *parts))
