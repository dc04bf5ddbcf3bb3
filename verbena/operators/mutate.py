"""Computing columns."""

from __future__ import annotations

import builtins
import re
from typing import Any

from pyspark.sql import functions as F

from verbena.expr import FUNCTIONS, Call, Col, Expr, Function, columns_of, function, verb
from verbena.frame import Context, Frame, Val, as_frame, is_table, quoted
from verbena.functions.factor import Factor, attach
from verbena.operators.select import resolve, selection

#: Functions of Python and numpy, and those of the grammar that they stand for.
NAMES = {"std": "sd", "nanmean": "mean", "nansum": "sum", "len": "length", "str": "as_character", "int": "as_integer", "float": "as_double", "bool": "as_logical", "ceil": "ceiling", "upper": "toupper", "lower": "tolower", "size": "length", "isnan": "is_na", "sorted": "sort"}
#: Functions of the grammar that also rename columns.
PLAIN_STRING = {"toupper": str.upper, "tolower": str.lower}


def named_function(fn: Any) -> Any:
    """The function of the grammar that a callable or a name stands for, else the callable."""
    if isinstance(fn, Function):
        return fn
    name = fn if isinstance(fn, str) else getattr(fn, "__name__", "")
    module = getattr(fn, "__module__", "") or ""
    if isinstance(fn, str) or getattr(builtins, name, None) is fn or module.startswith("numpy") or type(fn).__name__ == "ufunc":
        name = NAMES.get(name, name)
        if name in FUNCTIONS:
            return FUNCTIONS[name]
    return fn


def applied_to(fn: Any, value: Any, args=(), kwargs=None) -> Any:
    fn = named_function(fn)
    if isinstance(fn, Function):
        return Call(fn.__name__, (value, *args), kwargs or {})
    return fn(value, *args, **(kwargs or {}))


@function("special", always=True)
def across(ctx, *args, _names=None, **kwargs):
    """A function, a list or a dict of functions on each of some columns."""
    raise TypeError("across() stands at the top of a verb")


def bound_column(x: Any, name: str) -> Any:
    """``cur_column()`` replaced by the name of the column."""
    if isinstance(x, Call):
        return name if x.name == "cur_column" else Call(x.name, tuple(bound_column(a, name) for a in x.args), {k: bound_column(v, name) for k, v in x.kwargs.items()})
    if isinstance(x, Expr) and type(x).__name__ == "Op":
        return type(x)(x.symbol, tuple(bound_column(a, name) for a in x.args))
    return x


@function("special", always=True)
def cur_column(ctx, *ignored):
    """The column that ``across`` works on."""
    raise TypeError("cur_column() stands inside across()")


def expand_across(frame: Frame, call: Call) -> dict[str, Any]:
    """{name: expression} of an ``across`` call."""
    args, kwargs = list(call.args), dict(call.kwargs)
    glue = kwargs.pop("_names", None)
    fns = kwargs.pop("_fns", None)
    if "_cols" in kwargs:
        args.insert(0, kwargs.pop("_cols"))
    columns = args.pop(0) if args and not is_fns(args[0]) else None
    if fns is None and args:
        fns = args.pop(0)
    names = [n for n in (resolve(frame, columns) if columns is not None else frame.columns) if n not in frame.groups]
    if fns is None:
        return {n: Col(n) for n in names}
    table = fns if isinstance(fns, dict) else dict(enumerate(fns)) if isinstance(fns, (list, tuple)) else {None: fns}
    out = {}
    for n in names:
        for key, fn in table.items():
            if glue is not None:
                shown = glue.format(_col=n, _fn=0 if key is None else key, _fn1=(0 if key is None else key) + 1 if not isinstance(key, str) else key, _fn0=0 if key is None else key)
            else:
                shown = n if key is None else f"{n}_{key}"
            out[shown] = bound_column(applied_to(fn, Col(n), [bound_column(a, n) for a in args], {k: bound_column(v, n) for k, v in kwargs.items()}), n)
    return out


def is_fns(x: Any) -> bool:
    return isinstance(x, Function) or (callable(x) and not isinstance(x, Expr)) or isinstance(x, dict)


def quantifier(name: str, symbol: str):
    def lower(ctx, *args, _names=None, **kwargs):
        table = expand_across(ctx.frame, Call("across", args, kwargs))
        out = None
        for x in table.values():
            test = F.coalesce(ctx.val(x).col.cast("boolean"), F.lit(False))
            out = test if out is None else out | test if symbol == "|" else out & test
        return Val(F.lit(symbol == "&") if out is None else out, "row", any(ctx.val(x).window for x in table.values()))

    lower.__doc__ = f"Whether a test holds on {'any' if symbol == '|' else 'all'} of some columns; missing counts as false."
    return function("special", name, always=True)(lower)


if_any, if_all = quantifier("if_any", "|"), quantifier("if_all", "&")


def label(x: Any) -> str:
    if isinstance(x, Col):
        return str(x.name)
    return re.sub(r"\bf\.", "", repr(x))


def expanded(frame: Frame, args, kwargs) -> list[tuple[str | None, Any]]:
    """(name, expression) pairs of a verb's arguments, with ``across`` and dicts spread."""
    out: list[tuple[str | None, Any]] = []
    for a in args:
        if isinstance(a, Call) and a.name == "across":
            out += expand_across(frame, a).items()
        elif isinstance(a, Call) and a.name == "pick":
            out += [(new, Col(old)) for new, old in selection(frame, a.args, {}).items()]
        elif isinstance(a, Call) and a.name == "tibble_":
            out += [(label(x), x) for x in a.args] + list(a.kwargs.items())
        elif isinstance(a, dict):
            out += a.items()
        else:
            out.append((label(a), a))
    return out + list(kwargs.items())


def computed(frame: Frame, name: str, x: Any) -> Frame:
    """``frame`` with one more column (or one less, for None)."""
    if x is None:
        return frame.with_(frame.df.drop(name))
    if isinstance(x, Factor):
        x = listed(frame, list(x), x)
        return x(name)
    if isinstance(x, (list, tuple)) and not any(isinstance(v, Expr) for v in x) and not isinstance(x, str):
        return listed(frame, list(x), None)(name)
    if is_table(x):
        x = as_frame(x)
        raise TypeError("a frame is joined by bind_cols() or a join, not computed")
    ctx = Context(frame)
    v = ctx.val(x)
    if v.levels is None and isinstance(x, Col):
        meta = frame.df.schema[frame.columns[x.name] if isinstance(x.name, int) else x.name].metadata or {}
        v.levels = (meta["levels"], meta.get("ordered", False)) if "levels" in meta else None
    col = attach(v, name)
    out = ctx.frame
    if name in out.df.columns:
        df = out.df.select(*[col if c == name else quoted(c) for c in out.df.columns])
    else:
        return out.added(out.df.select("*", col))
    return out.with_(df)


def listed(frame: Frame, values: list, factor: Factor | None):
    """A driver-side vector as a column: joined on the position of the rows."""

    def add(name: str) -> Frame:
        from verbena.frame import frame_of

        if len(values) == 1:
            return computed(frame, name, values[0])
        numbered = frame.ordinal("__pos")
        other = frame_of({name: values}).df.withColumnRenamed("__row", "__pos")
        n = frame.df.count()
        if n != len(values):
            raise ValueError(f"{name} has {len(values)} values for {n} rows")
        base = numbered.df.drop(name) if name in numbered.df.columns else numbered.df
        out = base.join(other, "__pos", "left")
        col = attach(Val(quoted(name), levels=(factor.levels, factor.ordered) if factor else None), name)
        names = list(frame.columns) + ([] if name in frame.columns else [name])
        hidden = [h for h in numbered.df.columns if h.startswith("__")]
        return numbered.with_(out.select(*[col if c == name else quoted(c) for c in names], *map(quoted, hidden)), order=[("__pos", False)])

    return add


def without_scratch(frame: Frame) -> Frame:
    scratch = [c for c in frame.df.columns if re.match(r"__t\d+$", c) and c not in [o for o, _ in frame.order]]
    return frame.with_(frame.df.drop(*scratch)) if scratch else frame


@verb
def mutate(_data, *args, _keep="all", _before=None, _after=None, **kwargs):
    """Add or change columns, one after the other; None drops one. Aggregates are those of the
    group. Names that start with ``_`` are dropped at the end."""
    from verbena.operators.select import relocate

    if _keep not in ("all", "used", "unused", "none"):
        raise ValueError("_keep is all, used, unused or none")
    frame, made, used = _data, [], set()
    for name, x in expanded(_data, args, kwargs):
        used |= {_data.columns[c] if isinstance(c, int) else c for c in columns_of(x)}
        frame = computed(frame, name, x)
        if x is not None and name not in made:
            made.append(name)
    frame = without_scratch(frame)
    temporary = [n for n in made if n.startswith("_") and not n.startswith("__")]
    made = [n for n in made if n not in temporary]
    before = [c for c in _data.columns if c in frame.columns]
    kept = {"all": before, "used": [c for c in before if c in used or c in made or c in frame.groups], "unused": [c for c in before if c not in used or c in made or c in frame.groups], "none": [c for c in before if c in made or c in frame.groups]}[_keep]
    order = kept + [n for n in made if n not in kept]
    if _keep == "none":
        order = [g for g in frame.groups if g not in made] + made
    out = frame.keep(*map(quoted, order))
    fresh = [n for n in made if n not in _data.columns]
    if (_before is not None or _after is not None) and fresh:
        out = relocate.run(out, *fresh, _before=_before, _after=_after)
    return out


@verb
def transmute(_data, *args, _before=None, _after=None, **kwargs):
    """``mutate`` that keeps only the new columns and the groups."""
    return mutate.run(_data, *args, _keep="none", _before=_before, _after=_after, **kwargs)


# ---------------------------------------------------------------- context
@function("special", always=True)
def cur_group(ctx, *ignored):
    """Keys of the current group as one packed column."""
    return Val(F.struct(*ctx.partition()), "agg" if ctx.mode == "agg" and ctx.depth == 0 else "row")


def group_rows_of(ctx, make) -> Val:
    from verbena.functions.aggregate import applied

    return applied(ctx, make)


@function("special", always=True)
def cur_data(ctx, *ignored):
    """Rows of the current group without its keys, as a list of packed rows."""
    names = [c for c in ctx.frame.columns if c not in ctx.frame.groups]
    return group_rows_of(ctx, lambda A: A(F.collect_list(F.struct(*map(quoted, names)))))


@function("special", always=True)
def cur_data_all(ctx, *ignored):
    """Rows of the current group as a list of packed rows."""
    names = ctx.frame.columns
    return group_rows_of(ctx, lambda A: A(F.collect_list(F.struct(*map(quoted, names)))))


@function("special", always=True)
def cur_group_id(ctx, *ignored):
    """0-based number of the group, in the order of first appearance."""
    from verbena.operators.group import group_number

    ctx.frame, number = group_number(ctx.frame)
    if ctx.mode == "agg" and ctx.depth == 0:
        return Val(F.min(number), "agg")
    return Val(number)


@function("special", always=True)
def cur_group_rows(ctx, *ignored):
    """0-based positions of the rows of the group."""
    from verbena.functions.aggregate import applied

    ctx.frame = ctx.frame.ordinal("__at0")
    return applied(ctx, lambda A: F.sort_array(A(F.collect_list(quoted("__at0")))), vector=True)


