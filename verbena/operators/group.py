"""Grouping, and functions of whole groups."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from verbena.expr import verb
from verbena.frame import Frame, as_frame, quoted
from verbena.operators.select import resolve
from verbena.options import get_option
from verbena.operators.summarise import aggregate, grouped_keys


@verb
def group_by(_data, *args, _add=False, _drop=None, **kwargs):
    """Group by columns or by expressions, which are computed first."""
    frame, keys = grouped_keys(_data.with_(groups=[], rowwise=False) if not _add else _data, args, kwargs)
    keys = [*_data.groups, *keys] if _add else keys
    return frame.with_(groups=list(dict.fromkeys(keys)), rowwise=False, drop=_data.drop if _drop is None else _drop)


@verb
def ungroup(_data, *cols):
    """Remove all groups, or some."""
    gone = [n for c in cols for n in resolve(_data, c)]
    return _data.with_(groups=[g for g in _data.groups if cols and g not in gone], rowwise=False)


@verb
def rowwise(_data, *cols):
    """Every row is a group; columns can be kept as keys."""
    keys = [n for c in cols for n in resolve(_data, c)]
    return _data.with_(groups=keys or _data.groups, rowwise=True)


@verb
def group_by_drop_default(_data):
    """Whether empty groups are dropped."""
    return _data.drop


@verb
def group_vars(_data):
    """Names of the grouping columns."""
    return list(_data.groups)


@verb
def group_cols(_data):
    """0-based positions of the grouping columns."""
    return [_data.columns.index(g) for g in _data.groups]


def group_number(frame: Frame) -> tuple[Frame, Column]:
    """The frame with a hidden 0-based group number, by first appearance; groups are numbered
    once each and joined back, so that no task sees all rows."""
    if not frame.groups:
        return frame, F.lit(0).cast("bigint")
    own = frame.ordered()
    first = aggregate(own, frame.groups, [F.count("*").alias("__n")])
    numbered = first.ordinal("__gid").df.select(*[quoted(g).alias(f"__of_{g}") for g in frame.groups], "__gid")
    same = F.lit(True)
    for g in frame.groups:
        same = same & quoted(g).eqNullSafe(quoted(f"__of_{g}"))
    out = own.df.join(numbered, same, "left").select(*map(quoted, own.df.columns), "__gid")
    return own.with_(out), quoted("__gid")


@verb
def group_indices(_data):
    """0-based group number of every row."""
    frame, number = group_number(_data)
    return [r[0] for r in frame.df.orderBy(*frame.ordered().sort_columns()).select(number).collect()] if frame.order else [r[0] for r in frame.df.select(number).collect()]


@verb
def group_keys(_data):
    """One row of keys for each group."""
    out = aggregate(_data.ordered(), _data.groups, [F.count("*").alias("__n")])
    return out.keep(*map(quoted, _data.groups), groups=[])


@verb
def group_size(_data):
    """Rows of each group."""
    out = aggregate(_data.ordered(), _data.groups, [F.count("*").alias("n")])
    return [r[-1] for r in out.collect()]


def rows_of_groups(_data: Frame) -> Frame:
    numbered = _data.ordinal("__at0")
    rows = F.sort_array(F.collect_list(quoted("__at0"))).alias("_rows")
    return aggregate(numbered, _data.groups, [rows])


@verb
def group_rows(_data):
    """0-based positions of the rows of each group."""
    return [r[-1] for r in rows_of_groups(_data).collect()]


@verb
def group_data(_data):
    """Keys and row positions of each group."""
    return rows_of_groups(_data)


@verb
def n_groups(_data):
    """Number of groups."""
    return _data.df.select(*map(quoted, _data.groups)).distinct().count() if _data.groups else 1


def keys_in_order(_data: Frame) -> list[dict]:
    """The keys of all groups, for functions that work on one group after the other; more than the
    option ``max_groups`` of them are an error."""
    most = get_option("max_groups")
    rows = group_keys.run(_data).visible().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} groups: give group_modify() a _schema, or raise the option max_groups")
    return [dict(zip(_data.groups, r, strict=True)) for r in rows]


def one_group(_data: Frame, key: dict, keep: bool) -> Frame:
    test = F.lit(True)
    for k, v in key.items():
        test = test & quoted(k).eqNullSafe(F.lit(v))
    out = _data.with_(_data.df.where(test), groups=[], rowwise=False)
    return out if keep else out.keep(*[quoted(c) for c in out.columns if c not in key])


@verb
def group_split(_data, *args, _keep=False, **kwargs):
    """A lazy frame for each group."""
    if args or kwargs:
        _data = group_by.run(_data, *args, **kwargs)
    return [one_group(_data, key, _keep) for key in keys_in_order(_data)]


def called(fn, frame: Frame, key: dict, args, kwargs):
    """``fn`` of a group, and of its key if it has a place for one."""
    code = getattr(fn, "__code__", None)
    if code is not None and code.co_argcount > 1 + len(args):
        return fn(frame, key, *args, **kwargs)
    return fn(frame, *args, **kwargs)


@verb
def group_map(_data, _f, *args, _keep=False, **kwargs):
    """A function of the frame of each group; results one after the other."""
    keys = keys_in_order(_data) if _data.groups else [{}]
    return (called(_f, one_group(_data, key, _keep), key, args, kwargs) for key in keys)


@verb
def group_modify(_data, _f, *args, _keep=False, _schema=None, **kwargs):
    """A function of each group that gives a frame; the results with their keys. With
    ``_schema`` the function gets and gives pandas frames and runs on the cluster, group by
    group; without, it works on lazy frames whose results are stacked."""
    if _schema is not None:
        keys = _data.groups
        drop = [] if _keep else keys

        def run(key, rows: pd.DataFrame) -> pd.DataFrame:
            if hidden:  # rows are put in order inside their group
                rows = rows.sort_values(hidden, ascending=ascending, kind="stable", ignore_index=True)
            out = _f(rows.drop(columns=drop), *args, **kwargs)
            for k, v in zip(reversed(keys), reversed(key), strict=True):
                out.insert(0, k, v)
            return out

        fields = ", ".join([*(f"`{k}` {_data.dtype(k).simpleString()}" for k in keys), _schema])
        hidden = [o for o, _ in _data.order]
        drop += hidden
        ascending = [not d for _, d in _data.order]
        rows = _data.df.select(*map(quoted, _data.columns), *map(quoted, hidden)) if hidden else _data.df.select(*map(quoted, _data.columns))
        return Frame(rows.groupBy(*map(quoted, keys)).applyInPandas(run, fields), groups=keys)
    from verbena.operators.sets import bind_rows

    parts = []
    for key in keys_in_order(_data) if _data.groups else [{}]:
        out = as_frame(called(_f, one_group(_data, key, _keep), key, args, kwargs))
        parts.append(out.keep(*[F.lit(v).cast(_data.dtype(k)).alias(k) for k, v in key.items()], *[quoted(c) for c in out.columns if c not in key]))
    return bind_rows.run(parts[0], *parts[1:]).with_(groups=_data.groups)


@verb
def group_walk(_data, _f, *args, _keep=False, **kwargs):
    """A function of each group for its side effects; the frame goes on."""
    for _ in group_map.run(_data, _f, *args, _keep=_keep, **kwargs):
        pass
    return _data


@verb
def group_trim(_data, _drop=None):
    """Drop levels that no row has, and with them empty groups."""
    from verbena.expr import Call, Col
    from verbena.functions.factor import column_levels
    from verbena.operators.mutate import computed

    out = _data
    for g in _data.groups:
        if column_levels(_data, g) is not None:
            out = computed(out.with_(groups=[]), g, Call("fct_drop", (Col(g),)))
    return out.with_(groups=_data.groups, drop=_data.drop if _drop is None else _drop)


@verb
def with_groups(_data, _groups, _func, *args, **kwargs):
    """A verb under other groups (None: without)."""
    inner = _data.with_(groups=[]) if _groups is None else _data.with_(groups=resolve(_data, _groups))
    out = _func(inner, *args, **kwargs)
    return out.with_(groups=_data.groups) if isinstance(out, Frame) else out


