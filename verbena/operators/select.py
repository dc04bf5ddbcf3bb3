"""Column selection, renaming and order of columns. All is resolved on the driver."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import functions as F
from pyspark.sql import types as T

from verbena.expr import Call, Col, Function, Item, Op, Range, RangeList, function, verb
from verbena.frame import ColumnNotExistingError, Context, Frame, Val, clean, quoted


def as_names(x) -> list[str]:
    return [x] if isinstance(x, str) else [v.name if isinstance(v, Col) else v for v in x]


# ---------------------------------------------------------------- selectors
def by_text(name: str, holds: Callable[[str, str], bool], doc: str):
    def lower(frame: Frame, match, ignore_case=True, vars=None):
        low = (lambda s: s.lower()) if ignore_case else (lambda s: s)
        return [c for c in (vars or frame.columns) if any(holds(low(c), low(m)) for m in as_names(match))]

    lower.__doc__ = doc
    return function("select", name, always=True)(lower)


starts_with = by_text("starts_with", str.startswith, "Columns whose name starts with a text.")
ends_with = by_text("ends_with", str.endswith, "Columns whose name ends with a text.")
contains = by_text("contains", lambda c, m: m in c, "Columns whose name contains a text.")


@function("select", always=True)
def matches(frame, match, ignore_case=True, vars=None):
    """Columns whose name matches a regular expression."""
    flags = re.I if ignore_case else 0
    return [c for c in (vars or frame.columns) if any(re.search(m, c, flags) for m in as_names(match))]


@function("select", always=True)
def everything(frame):
    """All columns that are not grouped by."""
    return [c for c in frame.columns if c not in frame.groups]


@function("select", always=True)
def last_col(frame, offset=0, vars=None):
    """The last column, or one before it."""
    return [(vars or frame.columns)[-1 - offset]]


def num_range(prefix: str, range_, width: int | None = None) -> list[str]:
    """Names made of a prefix and numbers."""
    return [f"{prefix}{i:0{width}d}" if width else f"{prefix}{i}" for i in range_]


@function("select", always=True)
def all_of(frame, x):
    """Columns of these names; one that is missing is an error."""
    names = as_names(x)
    gone = [n for n in names if n not in frame.columns]
    if gone:
        raise ColumnNotExistingError(f"columns {gone} do not exist")
    return names


@function("select", always=True)
def any_of(frame, x, vars=None):
    """Those of the names that are columns."""
    return [n for n in as_names(x) if n in (vars or frame.columns)]


one_of = any_of


@function("select", always=True)
def group_cols_(frame):
    """The grouping columns."""
    return list(frame.groups)


@function("select", always=True)
def where(frame, fn):
    """Columns for which a test holds: a type test, or a function of the column's value that
    gives one truth value for the whole column."""
    from verbena.operators.mutate import named_function

    fn = named_function(fn)
    out = []
    for name in frame.columns:
        if isinstance(fn, Function):
            v = Context(frame.with_(groups=[]), "agg").val(Call(fn.__name__, (Col(name),)))
        else:
            got = fn(Col(name))
            if isinstance(got, bool):
                out += [name] * got
                continue
            v = Context(frame.with_(groups=[]), "agg").val(got)
        if isinstance(fn, Function) and hasattr(fn, "holds"):
            ok = fn.holds(frame.dtype(name))
        elif isinstance(fn, Function) and fn.__name__ in ("is_factor", "is_ordered"):
            meta = frame.df.schema[name].metadata or {}
            ok = "levels" in meta and (fn.__name__ == "is_factor" or meta.get("ordered"))
        else:
            ok = frame.df.agg(v.col.alias("x")).first()["x"]
        if ok:
            out.append(name)
    return out


def position(frame: Frame, x: Any) -> int:
    names = frame.columns
    if isinstance(x, Col):
        x = x.name
    if isinstance(x, int):
        return x if x >= 0 else len(names) + x
    if x not in names:
        raise ColumnNotExistingError(f"column {x!r} does not exist")
    return names.index(x)


def resolve(frame: Frame, x: Any) -> list[str]:
    """Names that a selector stands for."""
    names = frame.columns
    if isinstance(x, Col):
        return resolve(frame, x.name)
    if isinstance(x, str):
        if x not in names:
            raise ColumnNotExistingError(f"column {x!r} does not exist")
        return [x]
    if isinstance(x, bool):
        raise TypeError("a truth value selects nothing")
    if isinstance(x, int):
        if not -len(names) <= x < len(names):
            raise ColumnNotExistingError(f"position {x} does not exist")
        return [names[x]]
    if isinstance(x, RangeList):
        return resolve(frame, x.source)
    if isinstance(x, Range):
        out = [n for p in x.parts for n in (span(frame, p) if isinstance(p, slice) else resolve(frame, p))]
        return list(dict.fromkeys(out))
    if isinstance(x, slice):
        return span(frame, x)
    if isinstance(x, Op) and x.symbol in ("~", "neg"):
        gone = resolve(frame, x.args[0])
        return [n for n in names if n not in gone]
    if isinstance(x, Op) and x.symbol in ("&", "|", "-"):
        a, b = (resolve(frame, v) for v in x.args)
        return [n for n in a if n in b] if x.symbol == "&" else [n for n in a if n not in b] if x.symbol == "-" else list(dict.fromkeys(a + b))
    if isinstance(x, Call):
        from verbena.expr import FUNCTIONS

        fn = FUNCTIONS[x.name]
        if fn.kind == "select":
            return list(dict.fromkeys(fn.lower(frame, *x.args, **x.kwargs)))
        if x.name == "c_":
            return resolve(frame, list(x.args))
        if x.name == "desc":
            return resolve(frame, x.args[0])
        raise TypeError(f"{x.name}() does not select columns")
    if isinstance(x, Item):
        return resolve(frame, x.key)
    if isinstance(x, Function):
        return resolve(frame, where(x))
    if isinstance(x, (list, tuple, set, range)):
        items = list(x)
        if items and all(isinstance(i, int) and i < 0 for i in items):
            return resolve(frame, items[0]) if len(items) == 1 else [names[i] for i in items]
        return list(dict.fromkeys(n for i in items for n in resolve(frame, i)))
    raise TypeError(f"{x!r} does not select columns")


def span(frame: Frame, s: slice) -> list[str]:
    """Columns from start to stop; the stop is part of it only with a step."""
    names = frame.columns
    start = 0 if s.start is None else position(frame, s.start)
    stop = len(names) if s.stop is None else position(frame, s.stop)
    step = s.step or 1
    if s.step is not None and s.stop is not None:
        stop += 1 if step > 0 else -1
    return names[start:stop:step] if step > 0 or s.stop is None else [names[i] for i in range(start, stop, step)]


def selection(frame: Frame, args, kwargs) -> dict[str, str]:
    """{new name: old name} in order."""
    out: dict[str, str] = {}
    for i, a in enumerate(args):
        if i and isinstance(a, Op) and a.symbol in ("~", "neg"):
            gone = resolve(frame, a.args[0])
            out = {n: o for n, o in out.items() if o not in gone}
            continue
        if isinstance(a, dict):
            kwargs = {**a, **kwargs}
            continue
        out |= {n: n for n in resolve(frame, a)}
    for new, old in kwargs.items():
        (name,) = resolve(frame, old)
        if name in out and new != name:
            out = {(new if o == name else n): o for n, o in out.items()}
        else:
            out[new] = name
    return out


# ---------------------------------------------------------------- verbs
@verb
def select(_data, *args, **kwargs):
    """Keep columns, in the order given; ``new=old`` renames. Grouping columns stay."""
    picked = selection(_data, args, kwargs)
    for g in reversed([g for g in _data.groups if g not in picked.values()]):
        picked = {g: g} | picked
    renamed = {o: n for n, o in picked.items()}
    return _data.keep(*[quoted(o).alias(n) for n, o in picked.items()], groups=[renamed.get(g, g) for g in _data.groups])


def renamed(frame: Frame, mapping: dict[str, str]) -> Frame:
    """{old: new} for some columns."""
    order = [(mapping.get(o, o), d) for o, d in frame.order]
    return frame.with_(frame.df.withColumnsRenamed(mapping), groups=[mapping.get(g, g) for g in frame.groups], order=order)


@verb
def rename(_data, **kwargs):
    """New names: ``new=old``, the old one by name or position."""
    return renamed(_data, {resolve(_data, old)[0]: new for new, old in kwargs.items()})


@verb
def rename_with(_data, _fn, *args, **kwargs):
    """New names by a function of the old ones."""
    names = resolve(_data, args[0]) if args else _data.columns
    return renamed(_data, {n: new for n in names if (new := plain_call(_fn, n, args[1:], kwargs)) != n})


def plain_call(fn, x, args, kwargs):
    from verbena.operators.mutate import PLAIN_STRING

    return PLAIN_STRING.get(getattr(fn, "__name__", ""), fn)(x, *args, **kwargs)


@verb
def relocate(_data, *args, _before=None, _after=None, **kwargs):
    """Move columns to the front, or before or after others."""
    if _before is not None and _after is not None:
        raise ValueError("only one of _before and _after can be given")
    picked = selection(_data, args, kwargs)
    moved = list(picked.values())
    rest = [n for n in _data.columns if n not in moved]
    if _before is not None:
        target = resolve(_data, _before)
        at = min((rest.index(n) for n in target if n in rest), default=0)
    elif _after is not None:
        target = resolve(_data, _after)
        at = max((rest.index(n) for n in target if n in rest), default=len(rest) - 1) + 1
    else:
        at = 0
    names = {o: n for n, o in picked.items()}
    order = rest[:at] + moved + rest[at:]
    return renamed(_data.keep(*map(quoted, order)), {o: n for o, n in names.items() if o != n})


@verb
def pull(_data, var=-1, name=None, to=None):
    """One column as a list (or array, dict, frame): the last one by default."""
    (column,) = resolve(_data, var)
    if to == "frame":
        return _data.keep(quoted(column))
    rows = _data.to_dict()
    values = [clean(v) for v in rows[column]]
    if name is not None:
        (key,) = resolve(_data, name)
        return dict(zip(rows[key], values, strict=True))
    if to in (None, "list"):
        return values
    if to == "array":
        import numpy as np

        return np.array(values)
    if to == "series":
        import pandas as pd

        return pd.Series(values, name=column)
    raise ValueError(f"cannot pull to {to!r}")


@verb
def colnames(x, nested=True):
    """Column names; packed columns give ``outer$inner``."""
    out = []
    for s in x.schema:
        out += [f"{s.name}${k}" for k in s.dataType.fieldNames()] if nested and isinstance(s.dataType, T.StructType) else [s.name]
    return out


@verb(plain=9)
def set_colnames(x, names, nested=True):
    """Replace all column names."""
    return renamed(x, dict(zip(x.columns, names, strict=True)))


@verb
def ncol(x, nested=True):
    """Number of columns."""
    return len(colnames(x, nested=nested))


@verb
def nrow(x):
    """Number of rows."""
    return x.df.count()


@verb
def dim(x, nested=True):
    """(rows, columns)."""
    return nrow(x), ncol(x, nested=nested)


@verb
def glimpse(_data, width=None, formatter=None):
    """A preview: every column with its type and first values."""
    rows = _data.visible().limit(10).collect()
    print(f"Rows: {_data.df.count()}\nColumns: {len(_data.columns)}")
    for i, s in enumerate(_data.schema):
        values = ", ".join((formatter or str)(r[i]) for r in rows)
        print(f"$ {s.name} <{s.dataType.simpleString()}> {values}"[: width or 100])


@function("special", always=True)
def pick(ctx, *args):
    """Some columns as one packed column (spread at the top of a verb)."""
    return Val(F.struct(*[quoted(n) for n in selection(ctx.frame, args, {}).values()]))


@function("special", always=True)
def c_across(ctx, _cols=None):
    """Some columns as a vector in each row."""
    names = [n for n in (resolve(ctx.frame, _cols) if _cols is not None else ctx.frame.columns) if n not in ctx.frame.groups]
    kinds = [ctx.frame.dtype(n) for n in names]
    wide = any(isinstance(k, (T.FloatType, T.DoubleType)) for k in kinds)
    return Val(F.array(*[quoted(n).cast("double") if wide else quoted(n) for n in names]), "array")
