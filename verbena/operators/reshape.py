"""Reshaping: pivots, nesting, packing, expanding, separating."""

from __future__ import annotations

import re
from typing import Any

import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verbena.expr import Call, Col, Expr, Range, verb
from verbena.frame import Context, Frame, Val, as_frame, frame_of, is_float, is_number, is_table, literal, quoted
from verbena.functions.aggregate import na
from verbena.functions.factor import attach, column_levels
from verbena.names import repair_names
from verbena.operators.mutate import applied_to, computed, expanded, without_scratch
from verbena.operators.select import resolve
from verbena.options import few

CASTS = {int: "bigint", float: "double", str: "string", bool: "boolean", "int": "bigint", "float": "double", "str": "string", "bool": "boolean"}


def cast_name(kind: Any) -> str:
    return CASTS.get(kind, kind)


def chosen(frame: Frame, cols) -> list[str]:
    names = []
    for c in cols if isinstance(cols, (list, tuple)) else [cols]:
        names += [n for n in resolve(frame, c) if n not in names]
    return names


# ---------------------------------------------------------------- pivots
def widest(frame: Frame, names: list[str]) -> str | None:
    """A common type of columns that differ; None where they agree."""
    kinds = [frame.dtype(n) for n in names]
    if len({k.simpleString() for k in kinds}) <= 1:
        return None
    if all(is_number(k) or isinstance(k, T.BooleanType) for k in kinds):
        return "double" if any(map(is_float, kinds)) else "bigint"
    return "string"


@verb
def pivot_longer(
    _data, cols, names_to="name", names_prefix=None, names_sep=None, names_pattern=None, names_dtypes=None, names_transform=None, names_repair="check_unique", values_to="value", values_drop_na=False, values_dtypes=None, values_transform=None
):
    """Columns to rows. Parts of the names go to the columns of ``names_to``: ``.value`` names a
    column of values, a missing name discards a part."""
    names = chosen(_data, cols)
    targets = [names_to] if isinstance(names_to, str) else list(names_to)
    bare = [re.sub(f"^(?:{names_prefix})", "", n) if names_prefix else n for n in names]
    if names_pattern:
        found = [re.search(names_pattern, b) for b in bare]
        pieces = [list(m.groups()) if m else [None] * len(targets) for m in found]
    elif names_sep:
        pieces = [re.split(names_sep, b) if isinstance(names_sep, str) else split_at(b, names_sep) for b in bare]
    else:
        pieces = [[b] for b in bare]
    if any(len(p) != len(targets) for p in pieces):
        raise ValueError("names_to needs one name for each part")
    values, keys = {}, {}
    for name, parts in zip(names, pieces, strict=True):
        column = next((p for t, p in zip(targets, parts, strict=True) if t == ".value"), values_to)
        key = tuple(p for t, p in zip(targets, parts, strict=True) if t != ".value")
        keys.setdefault(key, {})[column] = name
        values.setdefault(column, []).append(name)
    shown = [t for t in targets if t != ".value"]

    def part(t: str, p: Any) -> Column:
        fn = names_transform.get(t) if isinstance(names_transform, dict) else names_transform
        kind = names_dtypes.get(t) if isinstance(names_dtypes, dict) else names_dtypes
        col = literal(fn(p) if fn and p is not None else p)
        return (col.cast(cast_name(kind)) if kind else col).alias(t)

    def value(column: str, name: str | None) -> Column:
        kind = (values_dtypes.get(column) if isinstance(values_dtypes, dict) else values_dtypes) or widest(_data, values[column])
        first = _data.dtype(values[column][0])
        col = F.lit(None).cast(first) if name is None else quoted(name)
        return (col.cast(cast_name(kind)) if kind else col).alias(column)

    rows = [F.struct(F.lit(i).alias("__i"), *[part(t, p) for t, p in zip(shown, key, strict=True) if t], *[value(c, members.get(c)) for c in values]) for i, (key, members) in enumerate(keys.items())]
    rest = [c for c in _data.columns if c not in names]
    frame = _data
    out = frame.df.select(*map(quoted, rest), *map(quoted, frame.hidden), F.inline(F.array(*rows)))
    made = [t for t in shown if t] + list(values)
    final = repair_names([*rest, *made], names_repair)
    fn = values_transform
    columns = [quoted(c).alias(n) for c, n in zip([*rest, *made], final, strict=True)]
    result = frame.with_(out.select(*columns, *map(quoted, frame.hidden), "__i"), order=[("__i", False), *frame.order] if frame.order else [])
    if values_drop_na:
        ctx = Context(result)
        test = None
        for c in values:
            good = ~na(ctx, quoted(c))
            test = good if test is None else test | good
        result = result.with_(result.df.where(test))
    if fn:
        for c in values:
            one = fn.get(c) if isinstance(fn, dict) else fn
            if one:
                result = computed(result, c, applied_to(one, Col(c)))
    return result


def split_at(text: str, positions) -> list[str]:
    positions = [positions] if isinstance(positions, int) else list(positions)
    edges = [0, *[p if p >= 0 else len(text) + p for p in positions], len(text)]
    return [text[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


@verb
def pivot_wider(_data, id_cols=None, names_from="name", names_prefix="", names_sep="_", names_glue=None, names_sort=False, values_from="value", values_fill=None, values_fn=None):
    """Rows to columns. Several values of one cell are averaged unless ``values_fn`` says
    otherwise. The new names are found by one small query on the distinct keys."""
    names, values = chosen(_data, names_from), chosen(_data, values_from)
    ids = chosen(_data, id_cols) if id_cols is not None else [c for c in _data.columns if c not in names + values]
    own = _data
    if names_sort or not own.order:
        keys = own.df.select(*map(quoted, names)).distinct()
        found = sorted((tuple(r) for r in few(keys, "new columns")), key=lambda r: tuple((v is None, v) for v in r)) if names_sort else [tuple(r) for r in few(keys.orderBy(*map(quoted, names)), "new columns")]
    else:
        first = own.df.groupBy(*map(quoted, names)).agg(F.min(F.struct(*[quoted(o) for o, _ in own.order])).alias("__f")).orderBy("__f")
        found = [tuple(r)[: len(names)] for r in few(first, "new columns")]
    columns = []

    def made(value: str, key: tuple) -> str:
        parts = names_sep.join("NA" if k is None else str(k) for k in key)
        if names_glue is not None:
            return names_glue.format(_value=value, **dict(zip(names, key, strict=True)))
        return f"{names_prefix}{parts}" if len(values) == 1 else f"{names_prefix}{value}{names_sep}{parts}"

    for v in values:
        fn = values_fn.get(v) if isinstance(values_fn, dict) else values_fn
        fill = values_fill.get(v) if isinstance(values_fill, dict) else values_fill
        kind = own.dtype(v)
        for key in found:
            test = F.lit(True)
            for n, k in zip(names, key, strict=True):
                test = test & quoted(n).eqNullSafe(F.lit(k))
            cell = F.when(test, quoted(v))
            if fn is not None:
                col = cell_aggregate(fn, cell, test)
            elif is_number(kind):
                col = F.avg(cell)
            else:
                col = F.first(cell, ignorenulls=True)
            columns.append((F.coalesce(col, literal(fill)) if fill is not None else col).alias(made(v, key)))
    from verbena.operators.summarise import aggregate

    return aggregate(own, ids, columns) if ids else Frame(own.df.agg(*columns))


def cell_aggregate(fn, cell: Column, test: Column) -> Column:
    """An aggregate over the rows of one cell."""
    from verbena.expr import Function
    from verbena.operators.mutate import named_function

    fn = named_function(fn)
    name = fn.__name__ if isinstance(fn, Function) else None
    table = {
        "mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "median": F.median, "sd": F.stddev_samp, "var": F.var_samp, "first": lambda c: F.first(c, ignorenulls=True),
        "last": lambda c: F.last(c, ignorenulls=True), "length": lambda c: F.count_if(test), "n": lambda c: F.count_if(test), "n_distinct": F.count_distinct, "prod": F.product,
    }
    if name in table:
        return table[name](cell)
    if fn is list or name == "c_":
        return F.collect_list(cell)

    @F.pandas_udf("double")
    def run(v: pd.Series) -> float:
        return float(fn(v.dropna()))

    return run(cell)


# ---------------------------------------------------------------- chop, nest, pack
def gathered(frame: Frame, col: Column) -> Column:
    """Values of a group as a list, in row order."""
    if not frame.order or any(d for _, d in frame.order):
        return F.collect_list(col)
    rows = F.array_sort(F.collect_list(F.struct(*[quoted(o) for o, _ in frame.order], col.alias("v"))))
    return F.transform(rows, lambda r: r.getField("v"))


@verb
def chop(data, cols=None):
    """Columns to lists, one row for each combination of the others."""
    from verbena.operators.summarise import aggregate

    names = chosen(data, cols) if cols is not None else [c for c in data.columns if c not in data.groups]
    own = data.ordered()
    keys = [c for c in data.columns if c not in names]
    packed = gathered(own, F.struct(*[quoted(n) for n in names]))
    out = aggregate(own, keys, [packed.alias("__z")])
    return out.with_(out.df.select(*map(quoted, keys), *[F.col("__z").getField(n).alias(n) for n in names], *[quoted(h) for h in out.hidden if h != "__z"])).with_(groups=data.groups)


def spread(data: Frame, names: list[str], keep_empty: bool) -> Frame:
    """Lists to rows, in lockstep; what is no list (or has one element) is repeated."""
    arrays = [n for n in names if isinstance(data.dtype(n), T.ArrayType)]
    rest = [c for c in data.columns if c not in arrays]
    if not arrays:
        return data
    zipped = F.arrays_zip(*[quoted(n) for n in arrays])
    longest = F.greatest(*[F.coalesce(F.size(quoted(n)), F.lit(0)) for n in arrays]) if len(arrays) > 1 else None
    if longest is not None:
        same = [F.when(F.size(quoted(n)) == 1, F.array_repeat(F.get(quoted(n), F.lit(0)), longest)).otherwise(quoted(n)).alias(n) for n in arrays]
        data = data.with_(data.df.select(*map(quoted, rest), *map(quoted, data.hidden), *same))
        zipped = F.arrays_zip(*[quoted(n) for n in arrays])
    explode = F.posexplode_outer if keep_empty else F.posexplode
    df = data.df.select(*map(quoted, rest), *map(quoted, data.hidden), explode(zipped).alias("__at", "__z"))
    columns = [F.col("__z").getField(c).alias(c) if c in arrays else quoted(c) for c in data.columns]
    return data.with_(df.select(*columns, *map(quoted, data.hidden), "__at"), order=[*data.order, ("__at", False)] if data.order else [])


@verb
def unchop(data, cols=None, keep_empty=False, dtypes=None):
    """Lists to rows; empty lists are dropped unless ``keep_empty``."""
    names = chosen(data, cols) if cols is not None else [c for c in data.columns if isinstance(data.dtype(c), T.ArrayType)]
    order = data.columns
    out = spread(data, names, keep_empty)
    kinds = dtypes if isinstance(dtypes, dict) else dict.fromkeys(names, dtypes) if dtypes else {}
    return out.keep(*[quoted(c).cast(cast_name(kinds[c])).alias(c) if c in kinds else quoted(c) for c in order])


@verb
def nest(_data, _names_sep=None, **cols):
    """Columns to lists of packed rows, one row for each combination of the others."""
    from verbena.operators.summarise import aggregate

    if not cols:
        cols = {"data": [c for c in _data.columns if c not in _data.groups]}
    inner = {name: chosen(_data, c) for name, c in cols.items()}
    used = {n for names in inner.values() for n in names}
    keys = [c for c in _data.columns if c not in used]
    own = _data.ordered()

    def short(name: str, n: str) -> str:
        return n[len(name) + len(_names_sep) :] if _names_sep and n.startswith(name + _names_sep) else n

    out = aggregate(own, keys, [gathered(own, F.struct(*[quoted(n).alias(short(name, n)) for n in names])).alias(name) for name, names in inner.items()])
    return out.with_(groups=_data.groups)


@verb
def unnest(data, *cols, keep_empty=False, dtypes=None, names_sep=None, names_repair="check_unique"):
    """Lists of packed rows (or lists) to rows."""
    names = chosen(data, cols)
    order = data.columns
    out = spread(data, names, keep_empty)
    columns, shown = [], []
    for c in order:
        kind = out.dtype(c)
        if c in names and isinstance(kind, T.StructType):
            for k in kind.fieldNames():
                columns.append(quoted(c).getField(k))
                shown.append(f"{c}{names_sep}{k}" if names_sep else k)
        else:
            columns.append(quoted(c))
            shown.append(c)
    shown = repair_names(shown, names_repair)
    kinds = dtypes if isinstance(dtypes, dict) else {}
    result = [c.cast(cast_name(kinds[n] if n in kinds else dtypes)).alias(n) if (n in kinds or (dtypes and not kinds and n not in order)) else c.alias(n) for c, n in zip(columns, shown, strict=True)]
    return out.keep(*result)


@verb
def pack(_data, _names_sep=None, **cols):
    """Columns to one packed column."""
    inner = {name: chosen(_data, c) for name, c in cols.items()}
    used = {n for names in inner.values() for n in names}

    def short(name: str, n: str) -> str:
        return n[len(name) + len(_names_sep) :] if _names_sep and n.startswith(name + _names_sep) else n

    return _data.keep(*[quoted(c) for c in _data.columns if c not in used], *[F.struct(*[quoted(n).alias(short(name, n)) for n in names]).alias(name) for name, names in inner.items()])


@verb
def unpack(data, cols, names_sep=None, names_repair="check_unique"):
    """A packed column to its columns."""
    names = chosen(data, cols)
    columns, shown = [], []
    for c in data.columns:
        kind = data.dtype(c)
        if c in names and isinstance(kind, T.StructType):
            columns += [quoted(c).getField(k) for k in kind.fieldNames()]
            shown += [f"{c}{names_sep}{k}" if names_sep else k for k in kind.fieldNames()]
        elif c in names:
            raise ValueError(f"{c} is not packed")
        else:
            columns.append(quoted(c))
            shown.append(c)
    return data.keep(*[c.alias(n) for c, n in zip(columns, repair_names(shown, names_repair), strict=True)])


# ---------------------------------------------------------------- expand and complete
class Nesting:
    """Combinations that occur together."""

    def __init__(self, args, kwargs):
        self.args, self.kwargs = args, kwargs


def nesting(*args, _name_repair="check_unique", **kwargs):
    """Combinations that occur; plain vectors give a frame."""
    if any(isinstance(a, (Expr, str)) for a in args) or any(isinstance(a, Expr) for a in kwargs.values()):
        return Nesting(args, kwargs)
    from verbena.operators.rows import arrange, distinct
    from verbena.operators.tibble import tibble

    out = distinct.run(tibble(*args, _name_repair=_name_repair, **kwargs))
    return arrange.run(out, *[Col(c) for c in out.columns])


def values_of(frame: Frame, name: str | None, x: Any) -> Frame:
    """Distinct sorted values of one argument of ``expand``."""
    if isinstance(x, Nesting):
        made, names = frame, []
        for n, e in expanded(frame, x.args, x.kwargs):
            if not (isinstance(e, Col) and n == e.name):
                made = computed(made, n, e)
            names.append(n)
        df = made.df.select(*map(quoted, names)).distinct()
        return Frame(df, order=[(n, False) for n in names])
    if is_table(x):
        x = as_frame(x)
        return Frame(x.df.select(*map(quoted, x.columns)).distinct(), order=[(c, False) for c in x.columns])
    if isinstance(x, Expr) and not isinstance(x, Range):
        if isinstance(x, Col) and column_levels(frame, x.name if isinstance(x.name, str) else frame.columns[x.name]) is not None:
            old = x.name if isinstance(x.name, str) else frame.columns[x.name]
            levels = column_levels(frame, old)
            base = frame_of({name: levels})
            return base.with_(base.df.select(attach(Val(quoted(name), levels=(levels, False)), name), *map(quoted, base.hidden)))
        if isinstance(x, Call) and x.name == "full_seq_":
            source = Context(frame).row(x.args[0])
            low, high = frame.df.agg(F.min(source), F.max(source)).first()
            from verbena.functions.scalar import full_seq

            return frame_of({name: full_seq([low, high], x.args[1], **x.kwargs)})
        col = Context(frame).col(x).alias(name)
        return Frame(frame.df.select(col).distinct(), order=[(name, False)])
    values = list(x) if isinstance(x, (list, tuple, range, Range)) else [x]
    return frame_of({name: sorted(dict.fromkeys(values))})


def crossed(parts: list[Frame]) -> Frame:
    """Every combination; the first part varies slowest."""
    out = None
    for i, p in enumerate(parts):
        order = [(o, f"__g{i}{k}") for k, (o, _) in enumerate(p.order)]
        df = p.df.select(*map(quoted, p.columns), *[quoted(o).alias(h) for o, h in order])
        out = df if out is None else out.crossJoin(df)
    hidden = [c for c in out.columns if c.startswith("__g")]
    names = [c for c in out.columns if c not in hidden]
    return Frame(out.select(*map(quoted, [*names, *hidden])), order=[(h, False) for h in hidden])


def expand_label(x: Any) -> str:
    if isinstance(x, Call) and x.name == "full_seq_" and isinstance(x.args[0], Col):
        return str(x.args[0].name)
    from verbena.operators.mutate import label

    return label(x)


@verb
def expand(data, *args, _name_repair="check_unique", **kwargs):
    """All combinations of values (levels of factors, ``nesting`` of what occurs together), in
    each group."""
    parts = []
    for x in args:
        if isinstance(x, str):
            x = Col(x)
        name = f"arg{len(parts)}" if not isinstance(x, Expr) else (data.columns[x.name] if isinstance(x, Col) and isinstance(x.name, int) else expand_label(x))
        parts.append((name, x))
    parts += list(kwargs.items())
    if not data.groups:
        return crossed([values_of(data, n, x) for n, x in parts])
    out = data.df.select(*map(quoted, data.groups)).distinct()
    for n, x in parts:
        if isinstance(x, (Expr, Nesting)) and not isinstance(x, Range):
            members = expanded(data, x.args, x.kwargs) if isinstance(x, Nesting) else [(n, x)]
            own = data.df.select(*map(quoted, data.groups), *[Context(data).col(e).alias(m) for m, e in members]).distinct()
            out = out.join(own, data.groups)
        else:
            out = out.crossJoin(values_of(data, n, x).df.select(quoted(n)))
    return Frame(out, groups=data.groups, order=[(c, False) for c in out.columns])


def crossing(*args, _name_repair="check_unique", **kwargs):
    """Distinct sorted combinations of vectors and frames."""
    parts = []
    for i, x in enumerate(args):
        parts.append(values_of(None, f"arg{i}", x))
    parts += [values_of(None, n, x) for n, x in kwargs.items()]
    return crossed(parts)


def expand_grid(x=None, *args, **kwargs):
    """All combinations of vectors and frames as they are; frames stay packed."""
    parts = []
    positional = [v for v in (x, *args) if v is not None]
    for name, v in [*((f"arg{i}", a) for i, a in enumerate(positional)), *kwargs.items()]:
        if is_table(v):
            own = as_frame(v).ordered()
            if name.startswith("arg"):
                parts.append(own)
            else:
                parts.append(own.with_(own.df.select(F.struct(*map(quoted, own.columns)).alias(name), *map(quoted, own.hidden))))
        else:
            parts.append(frame_of({name: list(v) if isinstance(v, (list, tuple, range, Range)) else [v]}))
    return crossed(parts)


@verb
def complete(data, *args, fill=None, explict=True, explicit=None):
    """Rows for all combinations; missing values are filled, those that were there before only
    if ``explict`` (or ``explicit``)."""
    explicit = explict if explicit is None else explicit
    grid = expand.run(data, *args)
    keys = [c for c in grid.columns if c in data.columns]
    own = data.ordered() if data.order else data
    marked = own.with_(own.df.withColumn("__old", F.lit(True)), groups=[])
    from verbena.operators.joins import full_join

    hidden_old = marked.with_(marked.df.withColumnRenamed("__old", "old_row_"))
    out = full_join.run(grid.with_(groups=[]), hidden_old, keys)
    columns = []
    for c in [*keys, *[c for c in data.columns if c not in keys]]:
        col = quoted(c)
        if fill and c in fill:
            value = literal(fill[c]).cast(data.dtype(c))
            col = F.coalesce(col, value) if explicit else F.when(F.col("old_row_"), col).otherwise(value)
        levels = column_levels(data, c)
        columns.append(attach(Val(col, levels=(levels, False) if levels is not None else None), c))
    return out.keep(*columns).with_(groups=data.groups)


# ---------------------------------------------------------------- fill
@verb
def fill(_data, *columns, _direction="down"):
    """Missing values from the row before or after, in each group."""
    names = chosen(_data, columns) if columns else [c for c in _data.columns if c not in _data.groups]
    if _direction not in ("down", "up", "downup", "updown"):
        raise ValueError("_direction is down, up, downup or updown")
    ctx = Context(_data.ordered())

    def filled(c: str) -> Column:
        x = F.when(~na(ctx, quoted(c)), quoted(c))
        steps = [ctx.hoist(ctx.nearest(x, back=way == "up")) for way in ("down", "up") if way in _direction]
        return F.coalesce(*(reversed(steps) if _direction == "updown" else steps))

    made = {c: filled(c) for c in names}
    columns = [c for c in _data.columns if not c.startswith("__")]
    return without_scratch(ctx.frame.keep(*[made[c].alias(c) if c in names else quoted(c) for c in columns]))


# ---------------------------------------------------------------- strings to columns
def converted(frame: Frame, names: list[str], convert) -> Frame:
    """Casts after splitting: by mapping, one type, or (True) what all values allow."""
    if not convert:
        return frame
    if convert is True:
        tests = []
        for n in names:
            x = quoted(n)
            tests += [F.bool_and(x.isNull() | x.try_cast("bigint").isNotNull()), F.bool_and(x.isNull() | x.try_cast("double").isNotNull())]
        row = frame.df.agg(*[t.alias(f"t{i}") for i, t in enumerate(tests)]).first()
        kinds = {n: "bigint" if row[2 * i] else "double" if row[2 * i + 1] else None for i, n in enumerate(names)}
    else:
        kinds = convert if isinstance(convert, dict) else dict.fromkeys(names, convert)
    return frame.keep(*[quoted(c).try_cast(cast_name(kinds[c])).alias(c) if kinds.get(c) else quoted(c) for c in frame.columns])


def replaced_at(frame: Frame, col: str, new: list[tuple[str, Column]], remove: bool) -> Frame:
    """New columns behind (or in place of) one."""
    columns = []
    names = [n for n, _ in new]
    for c in frame.columns:
        if c == col:
            columns += ([] if remove else [quoted(c)]) + [x.alias(n) for n, x in new]
        elif c not in names:
            columns.append(quoted(c))
    return frame.keep(*columns)


@verb
def separate(data, col, into, sep=r"[^0-9A-Za-z]+", remove=True, convert=False, extra="warn", fill="warn"):
    """One string column into several, by a pattern or at positions; a missing name discards a
    part. Too many parts are dropped or merged, too few are filled from the right or left."""
    (name,) = resolve(data, col)
    x = quoted(name).cast("string")
    k = len(into)
    if isinstance(sep, str):
        pieces = F.split(x, sep, k if extra == "merge" else -1)
        size = F.size(pieces)
        shift = F.greatest(F.lit(k) - size, F.lit(0)) if fill == "left" else F.lit(0)
        parts = [F.when(F.lit(i) >= shift, F.get(pieces, (F.lit(i) - shift).cast("int"))) for i in range(k)]
    else:
        at = [sep] if isinstance(sep, int) else list(sep)
        edges = [F.lit(0), *[F.lit(p) if p >= 0 else F.length(x) + p for p in at], F.length(x)]
        parts = [F.substring(x, edges[i] + 1, F.greatest(edges[i + 1] - edges[i], F.lit(0))) for i in range(len(edges) - 1)]
    new = [(n, p) for n, p in zip(into, parts, strict=False) if isinstance(n, str)]
    out = replaced_at(data, name, new, remove)
    return converted(out, [n for n, _ in new], convert)


@verb
def separate_rows(data, *columns, sep=r"[^0-9A-Za-z]+", convert=False):
    """String columns split into rows, in lockstep."""
    names = chosen(data, columns)
    frame = data.ordered() if data.order else data
    split = frame.keep(*[F.split(quoted(c), sep).alias(c) if c in names else quoted(c) for c in frame.columns])
    return converted(spread(split, names, True), names, convert)


@verb
def extract(data, col, into, regex=r"(\w+)", remove=True, convert=False):
    """Groups of a pattern into columns; without a match they are missing. Groups of one name
    are concatenated."""
    (name,) = resolve(data, col)
    into = [into] if isinstance(into, str) else list(into)
    x = quoted(name)
    found: dict[str, list[Column]] = {}
    for i, n in enumerate(into, 1):
        if isinstance(n, str):
            found.setdefault(n, []).append(F.regexp_extract(x, regex, i))
    new = [(n, F.when(x.rlike(regex), F.concat(*cols) if len(cols) > 1 else cols[0])) for n, cols in found.items()]
    return converted(replaced_at(data, name, new, remove), [n for n, _ in new], convert)


@verb
def unite(data, col, *columns, sep="_", remove=True, na_rm=True):
    """Several columns into one string."""
    names = chosen(data, columns) if columns else data.columns
    target = col.name if isinstance(col, Col) else col
    parts = [quoted(c).cast("string") for c in names]
    made = F.concat_ws(sep, *(parts if na_rm else [F.coalesce(p, F.lit("NA")) for p in parts])).alias(target)
    out = []
    for c in data.columns:
        if c == names[0]:
            out.append(made)
        if (c not in names or not remove) and c != target:
            out.append(quoted(c))
    return data.keep(*out)
