"""Factors: string columns whose levels and order are kept in the column's metadata.

On plain vectors a factor is a ``Factor`` (values, levels, ordered). Only functions that need
the levels present in a column run a small query, on distinct values.
"""

from __future__ import annotations

from collections import Counter
from typing import Any

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verbena.expr import function
from verbena.frame import Context, Val, clean, missing
from verbena.options import few


class Factor(list):
    """A plain factor: its values with levels."""

    def __init__(self, values, levels, ordered: bool = False):
        super().__init__(None if missing(v) or v not in levels else v for v in values)
        self.levels, self.ordered = list(levels), ordered

    def __repr__(self):
        return f"Factor({list(self)!r}, levels={self.levels!r}{', ordered=True' if self.ordered else ''})"


def metadata(levels: list, ordered: bool) -> dict:
    return {"levels": list(levels), "ordered": bool(ordered)}


def attach(v: Val, name: str) -> Column:
    """The column under a name, with its levels where it is a factor."""
    if v.levels is None:
        return v.col.alias(name)
    return v.col.alias(name, metadata=metadata(*v.levels))


def present(ctx: Context, col: Column) -> list[tuple[Any, int, Any]]:
    """(value, rows, first position) of each distinct value."""
    ctx.frame = ctx.frame.ordered()
    key = F.struct(*[F.col(f"`{o}`") for o, _ in ctx.frame.order])
    rows = ctx.df.groupBy(col.alias("v")).agg(F.count("*").alias("n"), F.min(key).alias("k")).orderBy("k")
    return [(r["v"], r["n"], i) for i, r in enumerate(few(rows, "distinct values")) if not missing(r["v"])]


def plain_levels(values, by_appearance: bool = False) -> list:
    seen = list(dict.fromkeys(v for v in values if not missing(v)))
    return seen if by_appearance else sorted(seen)


def to_factor(x, by_appearance: bool = False) -> Factor:
    if isinstance(x, Factor):
        return x
    x = [x] if isinstance(x, str) or not hasattr(x, "__iter__") else list(x)
    x = [clean(v) for v in x]
    appear = by_appearance and any(isinstance(v, str) for v in x)
    return Factor(x, plain_levels(x, appear))


def levels_of(ctx: Context, v: Val, by_appearance: bool = False) -> list:
    if v.levels is not None:
        return list(v.levels[0])
    found = [p[0] for p in present(ctx, v.col)]
    return found if by_appearance and isinstance(ctx.dtype(v.col), T.StringType) else sorted(found)


def mapped(col: Column, mapping: dict) -> Column:
    """Values replaced by a mapping of the levels; those without an entry are missing."""
    changed = {k: n for k, n in mapping.items() if k != n}
    if not changed:
        return col
    out = None
    for old, new in changed.items():
        value = F.lit(None if missing(new) else new)
        out = F.when(col == F.lit(old), value) if out is None else out.when(col == F.lit(old), value)
    return out.otherwise(col)


def level_function(compute, name: str | None = None, default_levels: bool = True):
    """A function of levels: ``compute(levels, ordered, counts, *args, **kwargs)`` returns
    (mapping old -> new, new levels, ordered). ``counts`` is a function that gives rows by level."""
    name = name or compute.__name__

    def plain(_f, *args, **kwargs):
        _f = to_factor(_f)
        w = kwargs.pop("w", None)
        weights = [1] * len(_f) if w is None else list(w)

        def counts():
            out: Counter = Counter({k: 0 for k in _f.levels})
            for v, k in zip(_f, weights, strict=True):
                if v is not None:
                    out[v] += k
            return out

        mapping, levels, ordered = compute(_f.levels, _f.ordered, counts, *args, **kwargs)
        return Factor([None if v is None else mapping.get(v, v) for v in _f], levels, ordered)

    def lower(ctx, _f, *args, **kwargs):
        v = ctx.val(_f)
        levels = levels_of(ctx, v)
        ordered = bool(v.levels and v.levels[1])
        w = kwargs.pop("w", None)

        def counts():
            total = F.count("*") if w is None else F.sum(ctx.col(w))
            out: Counter = Counter({k: 0 for k in levels})
            out.update({r["v"]: r["n"] for r in few(ctx.df.groupBy(v.col.alias("v")).agg(total.alias("n")), "distinct values") if r["v"] is not None})
            return out

        mapping, new, ordered = compute(levels, ordered, counts, *args, **kwargs)
        col = mapped(v.col.cast("string") if all(isinstance(k, str) for k in new) else v.col, mapping)
        gone = [k for k in levels if mapping.get(k, k) not in new]
        if gone:
            col = F.when(~v.col.isin(gone), col)
        return Val(col, v.form, v.window, (new, ordered))

    lower.__doc__ = compute.__doc__
    return function("row", name, eager=plain)(lower)


# ---------------------------------------------------------------- making factors
def _factor_plain(x=None, *, levels=None, labels=None, exclude=None, ordered=False, nmax=None):
    x = [] if x is None else x
    if isinstance(x, Factor) and levels is None:
        return Factor(x, [k for k in x.levels if k in x], ordered or x.ordered)
    x = [x] if isinstance(x, str) or not hasattr(x, "__iter__") else [clean(v) for v in x]
    out = [k for k in (plain_levels(x) if levels is None else levels) if k not in (exclude or ())]
    made = Factor(x, out, ordered)
    if labels is not None:
        names = dict(zip(out, labels, strict=True))
        made = Factor([names.get(v) for v in made], list(dict.fromkeys(labels)), ordered)
    return made


@function("row", eager=_factor_plain)
def factor(ctx, x, *, levels=None, labels=None, exclude=None, ordered=False, nmax=None):
    """Make a factor; levels are sorted by default, values outside them become missing."""
    v = ctx.val(x)
    out = [k for k in (levels_of(ctx, v) if levels is None else levels) if k not in (exclude or ())]
    col = F.when(v.col.isin(out), v.col) if levels is not None or exclude else v.col
    if labels is not None:
        col = mapped(col, dict(zip(out, labels, strict=True)))
        out = list(dict.fromkeys(labels))
    return Val(col, v.form, v.window, (out, ordered or bool(v.levels and v.levels[1])))


def ordered(x, levels=None, labels=None, exclude=None, nmax=None):
    """Make an ordered factor."""
    return factor(x, levels=levels, labels=labels, exclude=exclude, ordered=True)


@function("row", eager=lambda x: to_factor(x, True))
def as_factor(ctx, x):
    """A factor; levels of text in the order of appearance, of numbers sorted."""
    v = ctx.val(x)
    return Val(v.col, v.form, v.window, (levels_of(ctx, v, True), bool(v.levels and v.levels[1])))


as_categorical = as_factor


def _as_ordered_plain(x):
    out = to_factor(x, True)
    return Factor(out, out.levels, True)


@function("row", eager=_as_ordered_plain)
def as_ordered(ctx, x):
    """An ordered factor."""
    v = ctx.val(x)
    return Val(v.col, v.form, v.window, (levels_of(ctx, v, True), True))


def column_levels(frame, name: str) -> list | None:
    """Levels of a frame's column, None where it is no factor."""
    return (frame.df.schema[name].metadata or {}).get("levels")


def levels(x) -> list | None:
    """Levels of a plain factor."""
    return list(x.levels) if isinstance(x, Factor) else None


def nlevels(x) -> int:
    """Number of levels."""
    return len(levels(x) or ())


@function("row", eager=lambda x: isinstance(x, Factor))
def is_factor(ctx, x):
    """Whether a column is a factor."""
    return Val(F.lit(ctx.val(x).levels is not None), "const")


is_categorical = is_factor


@function("row", eager=lambda x: isinstance(x, Factor) and x.ordered)
def is_ordered(ctx, x):
    """Whether a column is an ordered factor."""
    v = ctx.val(x)
    return Val(F.lit(bool(v.levels and v.levels[1])), "const")


# ---------------------------------------------------------------- order of levels
def _same(levels):
    return {k: k for k in levels}


@level_function
def set_levels(levels, ordered, counts, new):
    """Levels renamed in their order."""
    return dict(zip(levels, new, strict=True)), list(dict.fromkeys(new)), ordered


@level_function
def fct_relevel(levels, ordered, counts, *lvls, after=None):
    """Move levels to the front, or behind position ``after``; a function reorders all."""
    if len(lvls) == 1 and callable(lvls[0]):
        return _same(levels), list(lvls[0](levels)), ordered
    moved = [x for v in lvls for x in (v if isinstance(v, (list, tuple)) else [v])]
    rest = [k for k in levels if k not in moved]
    if after is None:
        return _same(levels), moved + rest, ordered
    at = len(rest) if after in (-1, float("inf")) else after + 1
    return _same(levels), rest[:at] + moved + rest[at:], ordered


@level_function
def fct_infreq(levels, old, counts, ordered=None):
    """Most frequent levels first."""
    n = counts()
    return _same(levels), sorted(levels, key=lambda k: -n[k]), old if ordered is None else ordered


@level_function
def fct_inseq(levels, old, counts, ordered=None):
    """Levels by their numeric value."""

    def value(k):
        try:
            return (0, float(k))
        except ValueError:
            return (1, 0.0)

    return _same(levels), sorted(levels, key=value), old if ordered is None else ordered


def _inorder_plain(_f, ordered=None):
    _f = to_factor(_f)
    seen = plain_levels(_f, True)
    return Factor(_f, seen + [k for k in _f.levels if k not in seen], _f.ordered if ordered is None else ordered)


@function("row", eager=_inorder_plain)
def fct_inorder(ctx, _f, ordered=None):
    """Levels by first appearance."""
    v = ctx.val(_f)
    seen = [p[0] for p in present(ctx, v.col)]
    rest = [k for k in levels_of(ctx, v) if k not in seen] if v.levels else []
    return Val(v.col, v.form, v.window, (seen + rest, bool(v.levels and v.levels[1]) if ordered is None else ordered))


def _summary(fn, values: list, more: tuple, kwargs: dict) -> float:
    if fn is None:
        return float(np.median(values[0]))
    out = fn(*[list(v) for v in values], *more, **kwargs)
    return out[0] if isinstance(out, list) else out


def reorder(name: str, n_values: int, builtin, doc: str):
    def plain(_f, *args, _fun=None, _desc=n_values == 2, **kwargs):
        _f = to_factor(_f)
        values, more = args[:n_values], args[n_values:]

        def key(k):
            own = [[v for v, g in zip(x, _f, strict=True) if g == k] for x in values]
            if not own[0]:
                return float("inf")
            if n_values == 2 and _fun is None:
                return own[1][int(np.argmax(own[0]))]
            return _summary(_fun, own, more, kwargs)

        return Factor(_f, sorted(_f.levels, key=key, reverse=_desc), _f.ordered)

    def lower(ctx, _f, *args, _fun=None, _desc=n_values == 2, **kwargs):
        from verbena.expr import Call, Function
        from verbena.operators.mutate import named_function

        v = ctx.val(_f)
        inner = Context(ctx.frame.with_(groups=[], rowwise=False), "agg")
        cols = args[:n_values]
        if _fun is None:
            total = builtin(*[inner.row(c) for c in cols])
        else:
            fn = named_function(_fun)
            total = inner.col(Call(fn.__name__, tuple(args), kwargs) if isinstance(fn, Function) else fn(*args, **kwargs))
        rows = {r["v"]: r["s"] for r in few(inner.df.groupBy(v.col.alias("v")).agg(total.alias("s")), "distinct values")}
        known = levels_of(ctx, v)
        have = sorted((k for k in known if rows.get(k) is not None), key=lambda k: rows[k], reverse=_desc)
        return Val(v.col, v.form, v.window, (have + [k for k in known if k not in have], bool(v.levels and v.levels[1])))

    lower.__doc__ = doc
    return function("row", name, eager=plain)(lower)


fct_reorder = reorder("fct_reorder", 1, lambda x: F.median(x), "Levels by a summary (the median) of another column.")
fct_reorder2 = reorder("fct_reorder2", 2, lambda x, y: F.max_by(y, x), "Levels by a summary of two columns (the last y by x), descending.")


@level_function
def fct_shuffle(levels, ordered, counts):
    """Levels in random order."""
    from verbena.functions.random import _sample_plain

    return _same(levels), _sample_plain(levels), ordered


@level_function
def fct_rev(levels, ordered, counts):
    """Levels reversed."""
    return _same(levels), levels[::-1], ordered


@level_function
def fct_shift(levels, ordered, counts, n=1):
    """Levels rotated to the left."""
    n = n % max(len(levels), 1)
    return _same(levels), levels[n:] + levels[:n], ordered


@level_function
def lvls_reorder(levels, old, counts, idx, ordered=None):
    """Levels in the order of 0-based positions."""
    if sorted(idx) != list(range(len(levels))):
        raise ValueError("every position is needed exactly once")
    return _same(levels), [levels[i] for i in idx], old if ordered is None else ordered


# ---------------------------------------------------------------- names of levels
@level_function
def fct_anon(levels, ordered, counts, prefix=""):
    """Random numbers for levels."""
    from verbena.functions.random import _sample_plain

    width = len(str(len(levels) - 1))
    new = [f"{prefix}{i:0{width}d}" for i in range(len(levels))]
    mapping = dict(zip(levels, _sample_plain(new), strict=True))
    return mapping, new, ordered


@level_function
def fct_recode(levels, ordered, counts, *args, **kwargs):
    """New names for levels (new=old); a list merges, None removes a level."""
    pairs = [p for a in args for p in a.items()] + list(kwargs.items())
    mapping = _same(levels)
    for new, old in pairs:
        for k in old if isinstance(old, (list, tuple)) else [old]:
            if k in mapping:
                mapping[k] = None if missing(new) or new == "NULL" else new
    return mapping, list(dict.fromkeys(mapping[k] for k in levels if mapping[k] is not None)), ordered


@level_function
def fct_collapse(levels, ordered, counts, other_level=None, **kwargs):
    """Lists of levels under new names; the rest under ``other_level`` if given."""
    groups = {k: new for new, olds in kwargs.items() for k in (olds if isinstance(olds, (list, tuple)) else [olds])}
    mapping = {k: groups.get(k, k if other_level is None else other_level) for k in levels}
    new = list(dict.fromkeys(mapping.values()))
    if other_level in new:
        new = [k for k in new if k != other_level] + [other_level]
    return mapping, new, ordered


def _lumped(levels, keep, other_level, ordered):
    mapping = {k: k if k in keep else other_level for k in levels}
    new = [k for k in levels if k in keep]
    return mapping, new + [other_level] if len(new) < len(levels) else new, ordered


def _ranked(counts: dict, levels: list, ties: str, ascending: bool) -> dict:
    values = [(counts[k] if ascending else -counts[k]) for k in levels]
    out = {}
    for i, k in enumerate(levels):
        below = sum(v < values[i] for v in values)
        same = sum(v == values[i] for v in values)
        before = sum(v == values[i] for v in values[:i])
        out[k] = {"min": below + 1, "max": below + same, "average": below + (same + 1) / 2, "first": below + before + 1, "last": below + same - before}.get(ties, below + 1)
    return out


@level_function
def fct_lump_n(levels, ordered, counts, n, other_level="Other", ties_method="min"):
    """The n most frequent levels stay (the least frequent if negative)."""
    ranks = _ranked(counts(), levels, ties_method, n < 0)
    return _lumped(levels, {k for k in levels if ranks[k] <= abs(n)}, other_level, ordered)


@level_function
def fct_lump_min(levels, ordered, counts, min_, other_level="Other"):
    """Levels with at least so many rows stay."""
    c = counts()
    return _lumped(levels, {k for k in levels if c[k] >= min_}, other_level, ordered)


@level_function
def fct_lump_prop(levels, ordered, counts, prop, other_level="Other"):
    """Levels with more than a share of the rows stay (with less if negative)."""
    c = counts()
    total = sum(c.values()) or 1
    return _lumped(levels, {k for k in levels if (c[k] / total > prop if prop >= 0 else c[k] / total <= -prop)}, other_level, ordered)


def lowest_kept(c: dict, levels: list) -> set:
    """The most frequent levels, down to where all that is left is together smaller."""
    order = sorted(levels, key=lambda k: -c[k])
    left = sum(c.values())
    keep = set()
    for k in order:
        if c[k] > left - c[k] or not keep or left > c[k]:
            keep.add(k)
            left -= c[k]
            if c[k] > left:
                break
        else:
            break
    return keep


@level_function
def fct_lump_lowfreq(levels, ordered, counts, other_level="Other"):
    """Rare levels are lumped while the lump stays the smallest level."""
    return _lumped(levels, lowest_kept(counts(), levels), other_level, ordered)


def fct_lump(_f, n=None, prop=None, w=None, other_level="Other", ties_method="min"):
    """Lump by number, by share, or (with neither) the rare levels."""
    if n is not None:
        return fct_lump_n(_f, n, w=w, other_level=other_level, ties_method=ties_method)
    if prop is not None:
        return fct_lump_prop(_f, prop, w=w, other_level=other_level)
    return fct_lump_lowfreq(_f, other_level=other_level)


@level_function
def fct_other(levels, ordered, counts, keep=None, drop=None, other_level="Other"):
    """Levels to keep, or to drop into another level."""
    held = set(keep) if keep is not None else set(levels) - set(drop)
    return _lumped(levels, held, other_level, ordered)


@level_function
def fct_relabel(levels, ordered, counts, _fun, *args, **kwargs):
    """New names by a function of all levels (or of each)."""
    try:
        new = _fun(levels, *args, **kwargs)
    except (TypeError, AttributeError):
        new = [_fun(k, *args, **kwargs) for k in levels]
    new = list(new)
    return dict(zip(levels, new, strict=True)), list(dict.fromkeys(new)), ordered


@level_function
def lvls_revalue(levels, ordered, counts, new_levels):
    """New names, one for each level."""
    return dict(zip(levels, new_levels, strict=True)), list(dict.fromkeys(new_levels)), ordered


# ---------------------------------------------------------------- adding and dropping levels
@level_function
def fct_expand(levels, ordered, counts, *additional_levels):
    """More levels."""
    more = [x for v in additional_levels for x in (v if isinstance(v, (list, tuple)) else [v])]
    return _same(levels), list(dict.fromkeys([*levels, *more])), ordered


@level_function
def lvls_expand(levels, ordered, counts, new_levels):
    """A superset of the levels."""
    if set(levels) - set(new_levels):
        raise ValueError("the new levels lack old ones")
    return _same(levels), list(new_levels), ordered


def _explicit_plain(_f, na_level="(Missing)"):
    _f = to_factor(_f)
    if None not in _f:
        return _f
    return Factor([na_level if v is None else v for v in _f], list(dict.fromkeys([*_f.levels, na_level])), _f.ordered)


@function("row", eager=_explicit_plain)
def fct_explicit_na(ctx, _f, na_level="(Missing)"):
    """A level for missing values."""
    v = ctx.val(_f)
    return Val(F.coalesce(v.col.cast("string"), F.lit(na_level)), v.form, v.window, (list(dict.fromkeys([*levels_of(ctx, v), na_level])), bool(v.levels and v.levels[1])))


@level_function
def fct_drop(levels, ordered, counts, only=None):
    """Drop levels without rows (among ``only``)."""
    c = counts()
    only = levels if only is None else [only] if isinstance(only, str) else only
    return _same(levels), [k for k in levels if c[k] or k not in only], ordered


@level_function
def droplevels(levels, ordered, counts):
    """Drop levels without rows."""
    c = counts()
    return _same(levels), [k for k in levels if c[k]], ordered


def fct_unify(fs, levels=None) -> list[Factor]:
    """Factors with the union of their levels."""
    fs = [to_factor(x) for x in fs]
    union = lvls_union(fs) if levels is None else list(levels)
    return [Factor(x, union, x.ordered) for x in fs]


def lvls_union(fs) -> list:
    """Levels of all factors."""
    return list(dict.fromkeys(k for x in fs for k in to_factor(x).levels))


def fct_c(*fs) -> Factor:
    """Factors one after the other."""
    fs = [to_factor(x) for x in fs]
    return Factor([v for x in fs for v in x], lvls_union(fs))


def _cross_plain(*fs, sep=":", keep_empty=False):
    fs = [to_factor(x) for x in fs]
    values = [None if None in row else sep.join(map(str, row)) for row in zip(*fs, strict=True)]
    product = [""]
    for i, x in enumerate(reversed(fs)):
        product = [f"{k}{sep if i else ''}{p}" for p in product for k in x.levels]
    return Factor(values, product if keep_empty else [k for k in product if k in values])


@function("row", eager=_cross_plain)
def fct_cross(ctx, *fs, sep=":", keep_empty=False):
    """Combinations of levels."""
    values = [ctx.val(x) for x in fs]
    levels = [levels_of(ctx, v) for v in values]
    gap = values[0].col.isNull()
    for v in values[1:]:
        gap = gap | v.col.isNull()
    col = F.when(~gap, F.concat_ws(sep, *[v.col.cast("string") for v in values]))
    product = [""]
    for i, known in enumerate(reversed(levels)):
        product = [f"{k}{sep if i else ''}{p}" for p in product for k in known]
    if not keep_empty:
        have = {r[0] for r in few(ctx.df.select(col).distinct(), "distinct values")}
        product = [k for k in product if k in have]
    return Val(col, "row", False, (product, False))


def _match_plain(_f, lvls):
    _f, lvls = to_factor(_f), [lvls] if isinstance(lvls, str) else list(lvls)
    unknown = [k for k in lvls if k not in _f.levels]
    if unknown:
        raise ValueError(f"levels not present: {unknown}")
    return [v in lvls for v in _f]


@function("row", eager=_match_plain)
def fct_match(ctx, _f, lvls):
    """Whether a value is one of some levels; an unknown level is an error."""
    v, lvls = ctx.val(_f), [lvls] if isinstance(lvls, str) else list(lvls)
    unknown = [k for k in lvls if k not in levels_of(ctx, v)]
    if unknown:
        raise ValueError(f"levels not present: {unknown}")
    return Val(F.coalesce(v.col.isin(lvls), F.lit(False)), v.form, v.window)


def fct_unique(_f) -> Factor:
    """Values that occur, in the order of levels."""
    _f = to_factor(_f)
    return Factor([k for k in _f.levels if k in _f], _f.levels, _f.ordered)


