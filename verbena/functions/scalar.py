"""Tests, casts, dates, conditions, sets of values and vectors."""

from __future__ import annotations

import datetime
import math
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verbena.expr import Call, Expr, Range, function
from verbena.frame import Context, Val, is_float, is_number, literal, missing, type_of
from verbena.functions.aggregate import na

INF = float("inf")


# ---------------------------------------------------------------- tests of values
def rowwise_form(ctx, x) -> str:
    return ctx.val(x).form


@function("row")
def is_na(ctx, x):
    """Whether a value is missing (null or NaN)."""
    v = ctx.val(x)
    return Val(na(ctx, v.col), v.form, v.window)


is_nan = is_na


@function("row", eager=lambda x: x is None)
def is_null(ctx, x):
    """Whether a value is null."""
    v = ctx.val(x)
    return Val(v.col.isNull(), v.form, v.window)


@function("row")
def is_finite(ctx, x):
    """Whether a number is neither missing nor infinite."""
    col = ctx.col(x).cast("double")
    return Val(F.coalesce(~F.isnan(col) & (F.abs(col) < INF), F.lit(False)), rowwise_form(ctx, x))


@function("row")
def is_infinite(ctx, x):
    """Whether a number is infinite."""
    return Val(F.coalesce(F.abs(ctx.col(x).cast("double")) == INF, F.lit(False)), rowwise_form(ctx, x))


def is_true(x: Any) -> bool:
    """Whether a plain value is the value TRUE."""
    return isinstance(x, bool) and x


def is_false(x: Any) -> bool:
    """Whether a plain value is the value FALSE."""
    return isinstance(x, bool) and not x


def _inside(x, left, right, inclusive="both"):
    test = lambda v: not any(map(missing, (v, left, right))) and (v >= left if inclusive in ("both", "left") else v > left) and (v <= right if inclusive in ("both", "right") else v < right)
    return [test(v) for v in x] if isinstance(x, (list, tuple, range)) else test(x)


@function("row", eager=_inside)
def between(ctx, x, left, right, inclusive="both"):
    """Whether a value lies between two others; false if any of them is missing."""
    v = ctx.val(x)
    low, high = ctx.val(left), ctx.val(right)
    a = v.col >= low.col if inclusive in ("both", "left") else v.col > low.col
    b = v.col <= high.col if inclusive in ("both", "right") else v.col < high.col
    return Val(F.coalesce(a & b, F.lit(False)), v.form, v.window or low.window or high.window)


@function("row")
def near(ctx, x, y, tol=1e-8):
    """Whether two numbers differ by less than a tolerance."""
    return Val(F.abs(ctx.col(x) - ctx.col(y)) < tol, rowwise_form(ctx, x))


def _is_in_plain(x, y):
    pool = list(y) if isinstance(y, (list, tuple, set, range)) else [y]
    test = lambda v: v in pool or (missing(v) and any(map(missing, pool)))
    return [test(v) for v in x] if isinstance(x, (list, tuple, range)) else test(x)


@function("row", eager=_is_in_plain)
def is_element(ctx, x, y):
    """Whether a value is one of others."""
    v = ctx.val(x)
    if isinstance(y, Expr):
        pool = ctx.val(y).col
        from verbena.functions.aggregate import applied

        if ctx.val(y).form != "array":
            pool = applied(ctx, lambda A: A(F.collect_set(ctx.row(y)))).col
        return Val(F.coalesce(F.array_contains(pool, v.col), F.lit(False)), v.form, True)
    values = list(y) if isinstance(y, (list, tuple, set, range)) else [y]
    held = [a for a in values if not missing(a)]
    out = F.coalesce(v.col.isin(held), F.lit(False)) if held else F.lit(False)
    return Val(out | v.col.isNull() if len(held) < len(values) else out, v.form, v.window)


is_in = is_element


def _match_plain(x, table, nomatch=-1):
    table = list(table)
    return [table.index(v) if v in table else nomatch for v in (x if isinstance(x, (list, tuple, range)) else [x])]


@function("row", eager=_match_plain)
def match(ctx, x, table, nomatch=-1):
    """0-based position of the first match in a table."""
    at = F.array_position(literal(list(table)), ctx.col(x))
    return Val(F.when(at > 0, at - 1).otherwise(nomatch).cast("bigint"), rowwise_form(ctx, x))


@function("row")
def complete_cases(ctx, x):
    """Whether a row has no missing value."""
    col = ctx.col(x)
    kind = ctx.dtype(col)
    cols = [col.getField(n) for n in kind.fieldNames()] if isinstance(kind, T.StructType) else [col]
    out = F.lit(True)
    for c in cols:
        out = out & ~na(ctx, c)
    return Val(out)


# ---------------------------------------------------------------- tests of types
def type_test(name: str, holds, plain):
    def lower(ctx, x):
        return Val(F.lit(bool(holds(ctx.dtype(ctx.col(x))))), "const")

    lower.__doc__ = "Whether a column has the type."
    out = function("row", name, eager=lambda x: bool(plain(type_of(list(x)) if isinstance(x, (list, tuple, range)) else type_of([x]))))(lower)
    out.holds = holds
    return out


is_character = type_test("is_character", lambda t: isinstance(t, T.StringType), lambda t: isinstance(t, T.StringType))
is_logical = type_test("is_logical", lambda t: isinstance(t, T.BooleanType), lambda t: isinstance(t, T.BooleanType))
is_double = type_test("is_double", is_float, is_float)
is_integer = type_test("is_integer", lambda t: isinstance(t, T.IntegralType), lambda t: isinstance(t, T.IntegralType))
is_numeric = type_test("is_numeric", is_number, is_number)
is_complex = type_test("is_complex", lambda t: isinstance(t, T.StructType) and t.fieldNames() == ["re", "im"], lambda t: isinstance(t, T.StructType) and t.fieldNames() == ["re", "im"])
is_atomic = type_test("is_atomic", lambda t: not isinstance(t, (T.ArrayType, T.MapType, T.StructType)), lambda t: True)
is_atomic.eager = lambda x: not isinstance(x, (list, tuple, dict, range))
is_string, is_str, is_bool, is_float_, is_int = is_character, is_character, is_logical, is_double, is_integer


# ---------------------------------------------------------------- casts
def cast(name: str, make):
    def lower(ctx, x):
        v = ctx.val(x)
        kind = ctx.dtype(v.col)
        if v.levels is not None and name in ("as_integer", "as_numeric", "as_double"):
            code = F.array_position(F.array(*map(F.lit, v.levels[0])), v.col) - 1  # factor codes from 0
            return Val(F.when(v.col.isNotNull(), code.cast("bigint" if name != "as_double" else "double")), v.form, v.window)
        return Val(make(v.col, kind), v.form, v.window)

    lower.__doc__ = f"Cast; what cannot be cast is missing ({name})."
    return function("row", name)(lower)


def to_integer(x: Column, kind) -> Column:
    if isinstance(kind, T.StringType):
        return x.try_cast("double").try_cast("bigint")
    if isinstance(kind, T.DateType):
        return F.unix_date(x).cast("bigint")
    return x.try_cast("bigint")


def to_number(x: Column, kind) -> Column:
    if isinstance(kind, T.IntegralType | T.BooleanType):
        return x.cast("bigint")
    return x.try_cast("double")


as_double = cast("as_double", lambda x, k: x.try_cast("double"))
as_integer = cast("as_integer", to_integer)
as_logical = cast("as_logical", lambda x, k: x.try_cast("boolean"))
as_character = cast("as_character", lambda x, k: x.cast("string"))
as_numeric = cast("as_numeric", to_number)
as_int, as_float, as_str, as_string, as_bool = as_integer, as_double, as_character, as_character, as_logical


@function("row", eager=lambda x: None)
def as_null(ctx, x):
    """Always missing."""
    return Val(F.lit(None))


# Strftime directives and Java patterns.
DIRECTIVES = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy", "%b": "MMM", "%B": "MMMM", "%j": "DDD", "%f": "SSSSSS", "%p": "a", "%I": "hh", "%a": "EEE", "%A": "EEEE", "%e": "d", "%F": "yyyy-MM-dd", "%T": "HH:mm:ss", "%D": "MM/dd/yy"}
#: Formats that are tried where none is given.
TRY_FORMATS = ("%Y-%m-%d", "%Y/%m/%d", "%Y-%m-%d %H:%M:%S", "%Y/%m/%d %H:%M:%S")


def java_pattern(fmt: str) -> str:
    out, i = "", 0
    while i < len(fmt):
        if fmt[i] == "%":
            out += DIRECTIVES[fmt[i : i + 2]]
            i += 2
        else:
            out += f"'{fmt[i]}'" if fmt[i].isalpha() else fmt[i]
            i += 1
    return out


@function("row")
def as_date(ctx, x, *, format=None, try_formats=None, optional=False, tz=0, origin=None):
    """A date from text by formats, from days since an origin, or from a time in a zone (hours
    or a zone name)."""
    v = ctx.val(x)
    kind = ctx.dtype(v.col)
    if isinstance(kind, T.StringType):
        formats = [format] if isinstance(format, str) else list(format or try_formats or TRY_FORMATS)
        col = F.coalesce(*[F.to_date(F.try_to_timestamp(v.col, F.lit(java_pattern(p)))) for p in formats])
    elif is_number(kind):
        start = F.lit(origin or datetime.date(1970, 1, 1)).cast("date")
        col = F.date_add(start, v.col.cast("int"))
    elif isinstance(kind, T.DateType):
        col = v.col
    elif isinstance(tz, str):
        col = F.to_date(F.from_utc_timestamp(v.col, tz))
    else:
        col = F.to_date(v.col + F.make_dt_interval(F.lit(0), F.lit(int(tz))) if tz else v.col)
    return Val(col, v.form, v.window)


as_pd_date = as_date


# ---------------------------------------------------------------- conditions
def common(ctx: Context, cols: list[Column]) -> list[Column]:
    """Columns of one type: numbers widen, anything else that differs becomes text."""
    kinds = [ctx.dtype(c) for c in cols]
    held = [k for k in kinds if not isinstance(k, T.NullType)]
    if all(type(k) is type(held[0]) for k in held) if held else True:
        return cols
    if all(is_number(k) or isinstance(k, T.BooleanType) for k in held):
        return [c.cast("double" if any(map(is_float, held)) else "bigint") for c in cols]
    return [c.cast("string") for c in cols]


def form_of(values: list[Val]) -> tuple[str, bool]:
    from verbena.frame import combined

    return combined(values), any(v.window for v in values)


@function("row")
def if_else(ctx, condition, true, false, missing=None):
    """One value where a condition holds, another where not, a third where it is missing."""
    test, a, b, m = (ctx.val(v) for v in (condition, true, false, missing))
    yes, no, gap = common(ctx, [a.col, b.col, m.col])
    cond = test.col.cast("boolean")
    form, window = form_of([test, a, b])
    return Val(F.when(cond, yes).when(cond.isNull(), gap).otherwise(no), form, window)


@function("row")
def case_when(ctx, cond, value, *more):
    """The value of the first condition that holds."""
    pairs = [cond, value, *more]
    tests, values = [ctx.val(v) for v in pairs[::2]], [ctx.val(v) for v in pairs[1::2]]
    out = None
    for t, v in zip(tests, common(ctx, [v.col for v in values]), strict=True):
        test = t.col.cast("boolean")
        out = F.when(test, v) if out is None else out.when(test, v)
    form, window = form_of(tests + values)
    return Val(out, form, window)


@function("row")
def case_match(ctx, _x, *args, _default=None, _dtypes=None):
    """The value that belongs to the first list in which a value occurs."""
    v = ctx.val(_x)
    keys, values = args[::2], [ctx.val(a) for a in args[1::2]]
    default = ctx.val(_default)
    cols = common(ctx, [x.col for x in values] + [default.col])
    out = None
    for key, col in zip(keys, cols, strict=False):
        key = list(key) if isinstance(key, (list, tuple, range, Range)) else [key]
        held = [k for k in key if not missing(k)]
        test = v.col.isin(held) if held else F.lit(False)
        if len(held) < len(key):
            test = F.coalesce(test, F.lit(False)) | v.col.isNull()
        out = F.when(test, col) if out is None else out.when(test, col)
    out = out.otherwise(cols[-1])
    return Val(out.cast(_dtypes) if _dtypes else out, v.form, v.window)


@function("row")
def coalesce(ctx, x, *replace):
    """The first value that is not missing."""
    values = [ctx.val(v) for v in (x, *replace)]
    cols = [F.when(~na(ctx, v.col), v.col) for v in values[:-1]] + [values[-1].col]
    form, window = form_of(values)
    return Val(F.coalesce(*common(ctx, cols)), form, window)


@function("row")
def na_if(ctx, x, value):
    """Missing where a value equals another."""
    v, other = ctx.val(x), ctx.val(value)
    return Val(F.when(v.col == other.col, F.lit(None)).otherwise(v.col), v.form, v.window)


def recoding(args, kwargs) -> list[tuple[Any, Any]]:
    pairs: list[tuple[Any, Any]] = []
    position = 0
    for a in args:
        if isinstance(a, dict):
            pairs += a.items()
        else:
            pairs.append((position, a))
            position += 1
    return pairs + list(kwargs.items())


@function("row")
def recode(ctx, _x, *args, _default=None, _missing=None, **kwargs):
    """New values for old ones, by name, mapping or (for numbers) 0-based position. Others keep
    their value if it fits the new type, or get ``_default``."""
    v = ctx.val(_x)
    kind = ctx.dtype(v.col)
    pairs = recoding(args, kwargs)
    kinds = type_of([n for _, n in pairs if not missing(n)])
    out = None
    for old, new in pairs:
        old = old if not isinstance(kind, T.StringType) else str(old)
        test = v.col == F.lit(old)
        new_col = F.lit(None) if missing(new) else ctx.col(new)
        out = F.when(test, new_col) if out is None else out.when(test, new_col)
    if _missing is not None:
        out = out.when(v.col.isNull(), ctx.col(_missing))
    same = isinstance(kinds, type(kind)) or (is_number(kind) and is_number(kinds))
    rest = ctx.col(_default) if _default is not None else (v.col if same else F.lit(None))
    out = out.when(v.col.isNotNull(), rest)
    return Val(out, v.form, v.window)


@function("row")
def cut(ctx, x, breaks, labels=None, include_lowest=False, right=True, dig_lab=3, ordered_result=False):
    """A factor of the intervals in which numbers fall."""
    v = ctx.val(x)
    if isinstance(breaks, int):
        low, high = ctx.df.agg(F.min(v.col), F.max(v.col)).first()
        spread = (high - low) or abs(low) or 1
        step = spread / breaks
        edges = [low + step * i for i in range(breaks + 1)]
        edges[0], edges[-1] = low - spread / 1000, high + spread / 1000
    else:
        edges = sorted(breaks)
    shown = names_of(edges, dig_lab)
    n = len(edges) - 1
    if labels is False:
        names: list = list(range(n))
    elif labels is not None and labels is not True:
        names = list(labels)
    else:
        names = [f"({shown[i]},{shown[i + 1]}]" if right else f"[{shown[i]},{shown[i + 1]})" for i in range(n)]
        if include_lowest:
            names[0 if right else -1] = f"[{shown[0]},{shown[1]}]" if right else f"[{shown[-2]},{shown[-1]}]"
    out = None
    for i in range(n):
        low, high = F.lit(float(edges[i])), F.lit(float(edges[i + 1]))
        if right:
            test = ((v.col >= low) if include_lowest and i == 0 else (v.col > low)) & (v.col <= high)
        else:
            test = (v.col >= low) & ((v.col <= high) if include_lowest and i == n - 1 else (v.col < high))
        out = F.when(test, names[i]) if out is None else out.when(test, names[i])
    return Val(out, v.form, v.window, None if labels is False else (names, ordered_result))


def names_of(edges: list, digits: int) -> list[str]:
    """Edges with as few significant digits as keep them apart."""
    for d in range(digits, 17):
        out = [f"{e:.{d}g}" for e in edges]
        if len(set(out)) == len(out):
            return out
    return [str(e) for e in edges]


# ---------------------------------------------------------------- vectors
def listed(x) -> list:
    return list(x) if isinstance(x, (list, tuple, range, Range)) else [x]


@function("row", eager=lambda *a: [v for x in a for v in listed(x)])
def c_(ctx, *args):
    """Concatenate vectors."""
    out = [v.col if v.form == "array" or isinstance(ctx.dtype(v.col), T.ArrayType) else F.array(v.col) for v in map(ctx.val, args)]
    return Val(F.concat(*out), "array")


def _rep_plain(x, times=1, length=None, each=1):
    x = [v for v in listed(x) for _ in range(each)]
    out = [v for v, t in zip(x, times, strict=True) for _ in range(t)] if isinstance(times, (list, tuple)) else x * (times if length is None else math.ceil(length / max(len(x), 1)))
    return out if length is None else out[:length]


@function("row", eager=_rep_plain)
def rep(ctx, x, times=1, length=None, each=1):
    """Repeat a vector, each element or both."""
    v = ctx.val(x)
    a = v.col if v.form == "array" else F.array(v.col)
    if each != 1:
        a = F.flatten(F.transform(a, lambda e: F.array_repeat(e, each)))
    if length is not None:
        return Val(F.slice(F.flatten(F.array_repeat(a, length)), 1, length), "array")
    return Val(F.flatten(F.array_repeat(a, ctx.col(times).cast("int"))), "array")


def _seq_plain(from_=None, to=None, by=None, length_out=None, along_with=None):
    if along_with is not None:
        return list(range(1, len(listed(along_with)) + 1))
    if from_ is not None and to is None and by is None and length_out is None:
        return list(range(1, from_ + 1)) if isinstance(from_, int) else list(range(1, len(from_) + 1))
    if length_out is not None:
        if by is None and from_ is not None and to is not None:
            by = (to - from_) / (length_out - 1) if length_out > 1 else 0
        elif by is None:
            by = 1
        from_ = from_ if from_ is not None else (to - by * (length_out - 1) if to is not None else 1)
        return [from_ + by * i for i in range(length_out)]
    from_ = 1 if from_ is None else from_
    by = (1 if to >= from_ else -1) if by is None else by
    return [from_ + by * i for i in range(int(math.floor((to - from_) / by + 1e-10)) + 1)]


@function("row", eager=_seq_plain)
def seq(ctx, from_=None, to=None, by=None, length_out=None, along_with=None):
    """Regular numbers, both ends included."""
    step = F.lit(1) if by is None else ctx.col(by)
    return Val(F.sequence(ctx.col(1 if from_ is None else from_), ctx.col(to), step.cast("bigint")), "array")


@function("row", eager=lambda x: list(range(1, len(listed(x)) + 1)))
def seq_along(ctx, x):
    """1 to the length of a vector."""
    v = ctx.val(x)
    if v.form != "array":
        return Call("row_number")
    return Val(F.when(F.size(v.col) > 0, F.sequence(F.lit(1).cast("bigint"), F.size(v.col).cast("bigint"))).otherwise(F.array().cast("array<bigint>")), "array")


@function("row", eager=lambda x: list(range(1, x + 1)))
def seq_len(ctx, x):
    """1 to a number; nothing for 0."""
    n = ctx.col(x).cast("bigint")
    return Val(F.when(n > 0, F.sequence(F.lit(1).cast("bigint"), n)).otherwise(F.array().cast("array<bigint>")), "array")


@function("row", eager=lambda x: [len(v) if isinstance(v, (list, tuple, str)) and not isinstance(v, str) else 1 for v in x])
def lengths(ctx, x):
    """Sizes of the elements of a list column."""
    col = ctx.col(x)
    return Val((F.coalesce(F.size(col), F.lit(0)) if isinstance(ctx.dtype(col), T.ArrayType) else F.lit(1)).cast("bigint"))


def vector_function(name: str, eager, make, doc: str):
    def lower(ctx, x, *args, **kwargs):
        v = ctx.val(x)
        a = v.col
        if not isinstance(ctx.dtype(a), T.ArrayType):
            raise TypeError(f"{name}() needs a vector in each row; use a verb for whole columns")
        return Val(make(a, *args, **kwargs), "array")

    lower.__doc__ = doc
    return function("row", name, eager=eager)(lower)


def _sorted(x, decreasing=False, na_last=True):
    held = sorted((v for v in x if not missing(v)), reverse=decreasing)
    gaps = [v for v in x if missing(v)]
    return held if na_last is None else held + gaps if na_last else gaps + held


def _order_plain(x, decreasing=False, na_last=True):
    held = sorted((i for i, v in enumerate(x) if not missing(v)), key=lambda i: x[i], reverse=decreasing)
    gaps = [i for i, v in enumerate(x) if missing(v)]
    return held + gaps if na_last else gaps + held


def _unique(x):
    out: list = []
    for v in x:
        if v not in out and not (missing(v) and any(map(missing, out))):
            out.append(v)
    return out


def _append(x, values, after=-1):
    x = list(x)
    at = len(x) if after is None or after == -1 else after + 1
    return x[:at] + listed(values) + x[at:]


sort = vector_function("sort", _sorted, lambda a, decreasing=False, na_last=True: F.sort_array(a, not decreasing) if decreasing else F.array_sort(a), "Sorted vector.")
order = vector_function("order", _order_plain, lambda a, decreasing=False, na_last=True: F.transform(F.sort_array(F.transform(a, lambda v, i: F.struct(v.alias("v"), i.cast("bigint").alias("i"))), not decreasing), lambda s: s.getField("i")), "0-based permutation that sorts a vector.")
rev = vector_function("rev", lambda x: list(reversed(list(x))), F.reverse, "Reversed vector.")
unique_ = vector_function("unique", _unique, F.array_distinct, "Distinct values in their order.")
append = vector_function("append", _append, lambda a, values, after=-1: F.concat(a, literal(listed(values))) if after == -1 else F.concat(F.slice(a, 1, after + 1), literal(listed(values)), F.slice(a, F.lit(after + 2), F.size(a))), "Insert values behind a position.")


@function("row")
def full_seq_(ctx, x, period, tol=1e-6):
    """All multiples of a period between the least and the greatest value."""
    from verbena.functions.aggregate import applied

    col = ctx.row(x)
    return applied(ctx, lambda A: F.sequence(A(F.min(col)), A(F.max(col)), F.lit(period).cast("bigint")), vector=True)


def full_seq(x, period, tol=1e-6):
    """All multiples of ``period`` from the least to the greatest value; an error if the values
    are not regular."""
    if isinstance(x, Expr):
        return Call("full_seq_", (x, period), {"tol": tol})
    held = sorted(v for v in x if not missing(v))
    low, high = held[0], held[-1]
    if any(abs((v - low) / period - round((v - low) / period)) * period > tol for v in held):
        raise ValueError("the values are not a regular sequence")
    return [low + period * i for i in range(round((high - low) / period) + 1)]
