"""Set operations and binding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from verbena.expr import verb
from verbena.frame import Frame, as_frame, quoted
from verbena.names import repair_names


def same_columns(x: Frame, y: Frame) -> Frame:
    if set(x.columns) != set(y.columns):
        raise ValueError("both frames need the same columns")
    return y.keep(*map(quoted, x.columns))


def plain_of(frame: Frame):
    return frame.df.select(*map(quoted, frame.columns))


def unique_values(x) -> list:
    from verbena.functions.scalar import _unique

    return _unique(list(x))


@verb(tables=2, plain=2)
def union(x, y):
    """Distinct rows (or elements) of both."""
    if not isinstance(x, Frame):
        return unique_values([*x, *y])
    from verbena.operators.rows import distinct

    return distinct.run(union_all.run(x, y))


@verb(tables=2, plain=2)
def union_all(x, y):
    """All rows (or elements) of both."""
    if not isinstance(x, Frame):
        return [*x, *y]
    return bind_rows.run(x, same_columns(x, y)).with_(groups=x.groups)


@verb(tables=2, plain=2)
def intersect(x, y):
    """Distinct rows (or elements) that are in both."""
    if not isinstance(x, Frame):
        return [v for v in unique_values(x) if v in list(y)]
    y = same_columns(x, y)
    if x.order:
        return in_order(x, y, "left_semi")
    return Frame(plain_of(x).intersect(plain_of(y)), groups=x.groups)


@verb(tables=2, plain=2)
def setdiff(x, y):
    """Distinct rows (or elements) of x that are not in y."""
    if not isinstance(x, Frame):
        return [v for v in unique_values(x) if v not in list(y)]
    y = same_columns(x, y)
    if x.order:
        return in_order(x, y, "left_anti")
    return Frame(plain_of(x).subtract(plain_of(y)), groups=x.groups)


def in_order(x: Frame, y: Frame, how: str) -> Frame:
    """Distinct rows by a semi or anti join, which keeps the order of x."""
    from verbena.operators.joins import filtering
    from verbena.operators.rows import distinct

    return distinct.run(filtering(x, y, x.columns, "na", how))


@verb(tables=2, plain=2)
def symdiff(x, y):
    """Rows (or elements) that are in exactly one of the two."""
    if not isinstance(x, Frame):
        return [v for v in unique_values([*x, *y]) if (v in list(x)) != (v in list(y))]
    return union_all.run(setdiff.run(x, y), setdiff.run(same_columns(x, y), x))


@verb(tables=2, plain=2)
def setequal(x, y):
    """Whether both have the same rows (or elements)."""
    if not isinstance(x, Frame):
        return all(v in list(y) for v in x) and all(v in list(x) for v in y)
    if set(x.columns) != set(y.columns):
        return False
    a, b = plain_of(x), plain_of(same_columns(x, y))
    return a.subtract(b).isEmpty() and b.subtract(a).isEmpty()


def flat(data) -> list:
    out = []
    for d in data:
        out += flat(d) if isinstance(d, (list, tuple)) else [] if d is None else [d]
    return out


@verb(tables=2, plain=1)
def bind_rows(*data, _id=None, _copy=True, **kwargs):
    """Frames one below the other by column name; missing columns are filled with missing
    values. ``_id`` names the frame a row is from."""
    named = [(str(i), as_frame(d)) for i, d in enumerate(flat(data))] + [(k, as_frame(v)) for k, v in kwargs.items()]
    ordered = any(x.order for _, x in named)
    parts = []
    for i, (name, x) in enumerate(named):
        df = x.df
        columns = [quoted(c) for c in x.columns]
        if _id is not None:
            columns.insert(0, (F.lit(name) if kwargs else F.lit(int(name)).cast("bigint")).alias(_id))
        if ordered:
            x = x.ordinal("__pos") if any(d for _, d in x.order) or x.order != [("__row", False)] else x.with_(x.df.withColumnRenamed("__row", "__pos"))
            df = x.df
            columns += [F.lit(i).alias("__part"), F.col("__pos").cast("bigint").alias("__pos")]
        parts.append(df.select(*columns))
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    names = [c for c in out.columns if not c.startswith("__")]
    hidden = ["__part", "__pos"] if ordered else []
    return Frame(out.select(*map(quoted, [*names, *hidden])), groups=named[0][1].groups, order=[(h, False) for h in hidden])


@verb(tables=2, plain=1)
def bind_cols(*data, _name_repair="unique", _copy=True):
    """Frames side by side by row position; shorter ones are padded with missing values."""
    frames = [as_frame(d) for d in flat(data)]
    names = repair_names([c for x in frames for c in x.columns], _name_repair)
    out, at = None, 0
    for x in frames:
        own = x.ordinal("__pos")
        new = names[at : at + len(x.columns)]
        at += len(x.columns)
        df = own.df.select("__pos", *[quoted(c).alias(n) for c, n in zip(x.columns, new, strict=True)])
        out = df if out is None else out.join(df, "__pos", "full_outer")
    return Frame(out.select(*map(quoted, names), "__pos"), order=[("__pos", False)])


