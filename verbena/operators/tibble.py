"""Making frames, adding rows and columns, row names, small matrices."""

from __future__ import annotations

from typing import Any

import pandas as pd
from pyspark.sql import functions as F

from verbena.expr import Col, Expr, Range, function, has_expr, verb
from verbena.frame import RESERVED_ROWNAMES, ROW, ColumnNotExistingError, Frame, Val, as_frame, clean, frame_of, is_table, quoted, session
from verbena.functions.factor import Factor, metadata
from verbena.names import NameNonUniqueError, repair_names
from verbena.operators.mutate import computed, label
from verbena.operators.select import relocate, renamed, resolve


def vector(x: Any) -> list | None:
    """A driver-side vector; None where the argument is an expression or a frame."""
    if isinstance(x, (Expr,)) and not isinstance(x, Range):
        return None
    if is_table(x):
        return None
    if isinstance(x, (list, tuple, range, Range, pd.Series)) or (hasattr(x, "__array__") and not isinstance(x, (str, bytes))):
        return list(x)
    return [x]


def tibble(*args, _name_repair="check_unique", _rows=None, _dtypes=None, _drop_index=False, _index=None, **kwargs) -> Frame:
    """A frame of named vectors. Later arguments may refer to earlier columns; single values
    are recycled; frames are spliced when unnamed and packed when named."""
    pairs: list[tuple[str, Any]] = []
    for a in args:
        if is_table(a):
            frame = as_frame(a)
            pairs += [(c, v) for c, v in frame.to_dict().items()]
        elif isinstance(a, dict):
            pairs += a.items()
        elif isinstance(a, (list, tuple)) and a and isinstance(a[0], tuple):
            pairs += a
        else:
            pairs.append((label(a) if isinstance(a, Expr) else repr(a)[:30], a))
    pairs += kwargs.items()
    names = repair_names([k for k, _ in pairs], _name_repair)
    plain, later, levels = {}, [], {}
    for name, (_, x) in zip(names, pairs, strict=True):
        if is_table(x):
            rows = as_frame(x)
            x = [dict(zip(rows.columns, r, strict=True)) for r in rows.collect()]
        if isinstance(x, Factor):
            levels[name] = metadata(x.levels, x.ordered)
        if isinstance(x, (list, tuple)) and any(is_table(v) for v in x):
            x = [None if v is None else [dict(zip(as_frame(v).columns, r, strict=True)) for r in as_frame(v).collect()] if is_table(v) else v for v in x]
        v = None if has_expr(x) and not isinstance(x, (Range,)) else vector(x)
        if v is None:
            later.append((name, x))
        else:
            plain[name] = v
    sizes = {len(v) for v in plain.values() if len(v) != 1}
    n = _rows if _rows is not None else (sizes.pop() if len(sizes) == 1 else 1 if not sizes else None)
    if n is None or any(len(v) not in (1, n) for v in plain.values()):
        raise ValueError(f"lengths differ: { {k: len(v) for k, v in plain.items()} }")
    plain = {k: v * n if len(v) == 1 and n != 1 else v for k, v in plain.items()}
    # lists next to single values become lists of one
    for k, v in plain.items():
        if any(isinstance(x, list) for x in map(clean, v)) and not all(x is None or isinstance(x, list) for x in map(clean, v)):
            plain[k] = [x if x is None or isinstance(clean(x), list) else [x] for x in v]
    if not plain and not later:
        from pyspark.sql import types as T

        rows = session().createDataFrame([(i,) for i in range(_rows or 0)], T.StructType([T.StructField(ROW, T.LongType())]))
        return Frame(rows, order=[(ROW, False)])
    out = frame_of(plain) if plain else frame_of({"__one": [0]})
    if levels:
        out = out.keep(*[quoted(c).alias(c, metadata=levels[c]) if c in levels else quoted(c) for c in out.columns])
    for name, x in later:
        out = computed(out, name, x)
    out = out.keep(*map(quoted, names))
    if "__one" in out.df.columns:
        out = out.with_(out.df.drop("__one"))
    return typed(out, _dtypes)


def typed(frame: Frame, dtypes) -> Frame:
    if not dtypes:
        return frame
    from verbena.operators.reshape import cast_name

    kinds = dtypes if isinstance(dtypes, dict) else dict.fromkeys(frame.columns, dtypes)
    return frame.keep(*[quoted(c).cast(cast_name(kinds[c])).alias(c) if c in kinds else quoted(c) for c in frame.columns])


@function("special", always=True)
def tibble_(ctx, *args, _name_repair="check_unique", **kwargs):
    """A packed column of expressions, inside a verb."""
    return Val(F.struct(*[ctx.col(x).alias(label(x)) for x in args], *[ctx.col(x).alias(k) for k, x in kwargs.items()]))


def tribble(*dummies, _name_repair="minimal", _dtypes=None) -> Frame:
    """A frame written row by row: ``f.x`` headers first, then the values."""
    names = []
    for d in dummies:
        if not isinstance(d, Col):
            break
        names.append(d.name)
    values = dummies[len(names) :]
    if not names or len(values) % len(names):
        raise ValueError("the values do not fill whole rows")
    columns = [list(values[i :: len(names)]) for i in range(len(names))]
    return tibble(dict(zip(repair_names(names, _name_repair), columns, strict=True)), _name_repair=_name_repair, _dtypes=_dtypes)


def tibble_row(*args, _name_repair="check_unique", _dtypes=None, **kwargs) -> Frame:
    """A frame of exactly one row; vectors become lists."""
    out = tibble(*args, _name_repair=_name_repair, **{k: [v] if not has_expr(v) else v for k, v in kwargs.items()})
    return typed(out, _dtypes)


def as_tibble(df) -> Frame:
    """A frame of a Spark or pandas DataFrame, a dict or a list of rows."""
    if is_table(df):
        return as_frame(df)
    if isinstance(df, dict):
        return tibble(df)
    return tibble({k: [r.get(k) for r in df] for k in df[0]}) if isinstance(df, list) and df and isinstance(df[0], dict) else tibble(value=df)


as_data_frame = as_tibble


def enframe(x, name="name", value="value") -> Frame:
    """A dict or vector as a frame of names (0-based positions) and values."""
    pairs = list(x.items()) if isinstance(x, dict) else list(enumerate(x if isinstance(x, (list, tuple, range, Range)) else [x]))
    if name is None:
        return tibble({value: [v for _, v in pairs]})
    return tibble({name: [k for k, _ in pairs], value: [v for _, v in pairs]})


@verb
def deframe(x):
    """A frame of two columns as a dict, of one as a list."""
    columns = list(x.to_dict().values())
    return dict(zip(columns[0], columns[1], strict=True)) if len(columns) > 1 else columns[0]


@verb
def add_row(_data, *args, _before=None, _after=None, **kwargs):
    """Literal rows added at the end, or before or after a 0-based position."""
    if _data.groups:
        raise ValueError("rows cannot be added to a grouped frame")
    new = tibble(*args, **kwargs)
    unknown = [c for c in new.columns if c not in _data.columns]
    if unknown:
        raise ColumnNotExistingError(f"new rows cannot add columns {unknown}")
    at = None
    if _before is not None:
        at = _before
    elif _after is not None:
        at = _after + 1
    old = _data.ordinal("__pos")
    if at is None:
        from verbena.operators.sets import bind_rows

        return bind_rows.run(_data, new).keep(*map(quoted, _data.columns))
    left = old.df.select(*map(quoted, _data.columns), F.struct((F.col("__pos") >= at).cast("int").alias("p"), F.lit(1).alias("q"), F.col("__pos").alias("r")).alias("__pos"))
    right = new.df.select(*map(quoted, new.columns), F.struct(F.lit(0).alias("p"), F.lit(2).alias("q"), F.col(ROW).alias("r")).alias("__pos"))
    out = left.unionByName(right, allowMissingColumns=True)
    return Frame(out, order=[("__pos", False)])


add_case = add_row


@verb
def add_column(_data, *args, _before=None, _after=None, _name_repair="check_unique", _dtypes=None, **kwargs):
    """Columns added: single values, expressions, or vectors as long as the frame."""
    from verbena.operators.mutate import expanded

    out, made = _data, []
    for name, x in expanded(_data, args, kwargs):
        if name in _data.columns:
            raise NameNonUniqueError(f"column {name!r} exists already")
        v = None if has_expr(x) else vector(x)
        out = computed(out, name, x if v is None or len(v) == 1 and not isinstance(x, list) else v)
        made.append(name)
    out = typed(out, {k: v for k, v in (_dtypes or {}).items()} if isinstance(_dtypes, dict) else None)
    return relocate.run(out, *made, _before=_before, _after=_after) if _before is not None or _after is not None else out


# ---------------------------------------------------------------- row names
@verb
def has_rownames(_data):
    """Whether a frame has row names."""
    return RESERVED_ROWNAMES in _data.df.columns


@verb
def remove_rownames(_data):
    """Drop the row names."""
    return _data.with_(_data.df.drop(RESERVED_ROWNAMES))


@verb
def rownames_to_column(_data, var="rowname"):
    """Row names (or positions) as the first column."""
    if var in _data.columns:
        raise NameNonUniqueError(f"column {var!r} exists already")
    own = _data if RESERVED_ROWNAMES in _data.df.columns else _data.ordinal("__at0")
    source = RESERVED_ROWNAMES if RESERVED_ROWNAMES in own.df.columns else "__at0"
    out = own.keep(quoted(source).alias(var), *map(quoted, _data.columns))
    return out.with_(out.df.drop(RESERVED_ROWNAMES))


@verb
def rowid_to_column(_data, var="rowid"):
    """Positions from 0 as the first column."""
    own = _data.ordinal("__at0")
    return own.keep(F.col("__at0").alias(var), *map(quoted, _data.columns))


@verb
def column_to_rownames(_data, var="rowname"):
    """A column as row names."""
    (name,) = resolve(_data, var)
    return renamed(_data.with_(_data.df.drop(RESERVED_ROWNAMES)), {name: RESERVED_ROWNAMES})


has_index, remove_index, drop_index, index_to_column, column_to_index = has_rownames, remove_rownames, remove_rownames, rownames_to_column, column_to_rownames


@verb
def rownames(x):
    """The row names, or positions from 0."""
    if RESERVED_ROWNAMES in x.df.columns:
        df = x.df.orderBy(*x.sort_columns()) if x.order else x.df
        return [r[0] for r in df.select(quoted(RESERVED_ROWNAMES)).collect()]
    return list(range(x.df.count()))


@verb
def set_rownames(x, names):
    """Row names from a vector."""
    if names is None:
        return remove_rownames.run(x)
    out = computed(x.with_(x.df.drop(RESERVED_ROWNAMES)), "rowname_", list(names))
    return renamed(out, {"rowname_": RESERVED_ROWNAMES})


# ---------------------------------------------------------------- matrices
@verb(plain=1)
def t(x):
    """Rows and columns exchanged; for frames that fit the driver."""
    if not isinstance(x, Frame):
        return [list(r) for r in zip(*x, strict=True)]
    rows = x.collect()
    return frame_of({str(i): list(r) for i, r in enumerate(rows)})


def diag(x=None, nrow=None, ncol=None):
    """The diagonal of a frame, or a diagonal matrix of a vector or size."""
    return _diag(x, nrow, ncol) if x is None or is_table(x) else _diag.run_fn(x, nrow, ncol)


@verb
def _diag(x, nrow=None, ncol=None):
    if isinstance(x, Frame):
        return [r[i] for i, r in enumerate(x.collect()) if i < len(r)]
    values = list(x) if isinstance(x, (list, tuple, range, Range)) else [1] * x if nrow is None and isinstance(x, int) else [x]
    n = nrow or len(values)
    m = ncol or n
    return frame_of({str(j): [values[i % len(values)] if i == j else 0 for i in range(n)] for j in range(m)})


def outer(x, y, fun="*") -> Frame:
    """A function of all pairs of two vectors, as a matrix."""
    import operator

    fn = {"*": operator.mul, "+": operator.add, "-": operator.sub, "/": operator.truediv, "**": operator.pow, "%": operator.mod, "//": operator.floordiv}.get(fun, fun) if isinstance(fun, str) else fun
    return frame_of({str(j): [fn(a, b) for a in x] for j, b in enumerate(y)})
