"""Two-table verbs: joins and row modifications."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbena.expr import Col, Op, verb
from verbena.frame import SAMPLE, Frame, is_scan, quoted

#: Rows of a key in a look at the other table from which on rows are dealt evenly before they meet.
FANOUT = 16
MULTIPLE = ("all", "first", "last", "any", "error", "warning")


def join_keys(x: Frame, y: Frame, by) -> list[tuple[str, str]]:
    """(left, right) names to join by."""
    if by is None:
        both = [c for c in x.columns if c in y.columns]
        if not both:
            raise ValueError("no common columns to join by")
        return [(c, c) for c in both]
    name = lambda c: c.name if isinstance(c, Col) else c
    if isinstance(by, dict):
        return [(name(k), name(v)) for k, v in by.items()]
    if isinstance(by, Op) and by.symbol == "==":
        return [(name(by.args[0]), name(by.args[1]))]
    return [(name(c), name(c)) for c in (by if isinstance(by, (list, tuple)) else [by])]


def prefixed(frame: Frame, side: str) -> DataFrame:
    """Unambiguous names for a join."""
    return frame.df.select(*[quoted(c).alias(f"__{side}_{c}") for c in frame.df.columns])


def matches(pairs, na_matches: str) -> Column:
    tests = []
    for a, b in pairs:
        left, right = F.col(f"`__x_{a}`"), F.col(f"`__y_{b}`")
        tests.append(left.eqNullSafe(right) if na_matches == "na" else left == right)
    return reduce(lambda p, q: p & q, tests)


def one_match(y: Frame, pairs, multiple: str) -> Frame:
    """One row of ``y`` for each key where only one match is wanted."""
    keys = [quoted(b) for _, b in pairs]
    if multiple == "any":
        rest = [c for c in y.df.columns if c not in [b for _, b in pairs]]
        return y.with_(y.df.groupBy(*keys).agg(*[F.any_value(quoted(c)).alias(c) for c in rest]).select(*map(quoted, y.df.columns)))
    own = y.ordered()
    window = Window.partitionBy(*keys).orderBy(*own.sort_columns(multiple == "last"))
    return own.with_(own.df.withColumn("__n", F.row_number().over(window)).where("__n = 1").drop("__n"))


def checked(x: Frame, y: Frame, pairs, relationship, unmatched, how: str, na_matches: str) -> None:
    """Errors for what ``relationship`` and ``unmatched`` exclude."""
    if relationship:
        one_x, one_y = relationship.split("-to-")
        for frame, keys, one, side in ((y, [b for _, b in pairs], one_y, "y"), (x, [a for a, _ in pairs], one_x, "x")):
            if one == "one" and not frame.df.groupBy(*map(quoted, keys)).count().where("count > 1").isEmpty():
                raise ValueError(f"each row may match one row of {side} at most ({relationship})")
    if unmatched == "error":
        a, b = prefixed(x, "x"), prefixed(y, "y")
        if how in ("inner", "right") and not a.join(b, matches(pairs, na_matches), "left_anti").isEmpty():
            raise ValueError("rows of x have no match")
        back = reduce(lambda p, q: p & q, [F.col(f"`__y_{r}`").eqNullSafe(F.col(f"`__x_{l}`")) for l, r in pairs])
        if how in ("inner", "left") and not b.join(a, back, "left_anti").isEmpty():
            raise ValueError("rows of y have no match")


def dealt(df: DataFrame, other: Frame, keys: list[str], na_matches: str) -> DataFrame:
    """Rows that each meet many of the other table, as a few of its rows show, are dealt evenly
    first: what they make is done where they lie, and a table of few files or row groups lies in
    few tasks, however many rows it makes."""
    if df.isStreaming or not is_scan(other.df):
        return df
    seen = other.df.select(*map(quoted, keys)).limit(SAMPLE).collect()
    seen = [r for r in seen if na_matches == "na" or all(v is not None for v in r)]
    if len(seen) < FANOUT * max(len({repr(r) for r in seen}), 1):
        return df
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism))


def mutating(how: str):
    def join(x, y, by=None, copy=False, suffix=("_x", "_y"), keep=False, na_matches="na", multiple="all", unmatched="drop", relationship=None, hint=None):
        if na_matches not in ("na", "never") or multiple not in MULTIPLE:
            raise ValueError("na_matches is na or never, multiple is all, first, last or any")
        pairs = join_keys(x, y, by)
        checked(x, y, pairs, relationship, unmatched, how, na_matches)
        if multiple in ("first", "last", "any"):
            y = one_match(y, pairs, multiple)
        ordered = bool(x.order or y.order)
        if ordered:
            x, y = (side if side.order else side.ordered() for side in (x, y))
        left, right = prefixed(x, "x"), prefixed(y, "y")
        if how in ("inner", "left") and multiple == "all":
            left = dealt(left, y, [b for _, b in pairs], na_matches)
        elif how == "right":
            right = dealt(right, x, [a for a, _ in pairs], na_matches)
        right = right.hint(hint) if hint else right
        test = matches(pairs, na_matches)
        joined = left.join(right, test, {"full": "full_outer"}.get(how, how))
        keys_y = {b: a for a, b in pairs}
        columns = []
        taken = set(x.columns)
        names_y = [c for c in y.columns if keep or c not in keys_y]
        both = {c for c in names_y if c in taken}
        for c in x.columns:
            col = F.col(f"`__x_{c}`")
            partner = next((b for a, b in pairs if a == c), None)
            if partner is not None and not keep:
                other = F.col(f"`__y_{partner}`")
                col = other if how == "right" else F.coalesce(col, other) if how == "full" else col
            name = c + suffix[0] if c in both else c
            columns.append(with_metadata(x, c, col, name))
        for c in names_y:
            columns.append(with_metadata(y, c, F.col(f"`__y_{c}`"), c + suffix[1] if c in both else c))
        order = []
        if ordered:
            sides = (("x", x), ("y", y))
            for side, frame in sides:
                for i, (o, d) in enumerate(frame.order):
                    name = f"__o{side}{i}"
                    columns.append(F.col(f"`__{side}_{o}`").alias(name))
                    order.append((name, d))
        groups = [g + suffix[0] if g in both else g for g in x.groups]
        return Frame(joined.select(*columns), groups=groups, rowwise=x.rowwise, order=order, drop=x.drop)

    join.__name__ = f"{how}_join"
    join.__doc__ = f"{how.capitalize()} join by common, named or mapped columns; missing keys match each other unless ``na_matches='never'``."
    return verb(join, tables=2)


def with_metadata(frame: Frame, name: str, col: Column, alias: str) -> Column:
    meta = frame.df.schema[name].metadata
    return col.alias(alias, metadata=meta) if meta else col.alias(alias)


inner_join, left_join, right_join, full_join = (mutating(h) for h in ("inner", "left", "right", "full"))


def filtering(x: Frame, y: Frame, by, na_matches: str, how: str) -> Frame:
    pairs = join_keys(x, y, by)
    right = y.df.select(*[quoted(b).alias(f"__y_{b}") for b in dict.fromkeys(b for _, b in pairs)])
    tests = [quoted(a).eqNullSafe(F.col(f"`__y_{b}`")) if na_matches == "na" else quoted(a) == F.col(f"`__y_{b}`") for a, b in pairs]
    return x.with_(x.df.join(right, reduce(lambda p, q: p & q, tests), how))


@verb(tables=2)
def semi_join(x, y, by=None, copy=False, na_matches="na"):
    """Rows of x that have a match in y."""
    return filtering(x, y, by, na_matches, "left_semi")


@verb(tables=2)
def anti_join(x, y, by=None, copy=False, na_matches="na"):
    """Rows of x that have no match in y."""
    return filtering(x, y, by, na_matches, "left_anti")


@verb(tables=2)
def nest_join(x, y, by=None, copy=False, keep=False, name=None, na_matches="na", unmatched="drop"):
    """All rows of x, each with the list of its matches in y."""
    pairs = join_keys(x, y, by)
    if unmatched == "error":
        checked(x, y, pairs, None, unmatched, "left", na_matches)
    name = name or "_y_joined"
    keys = [b for _, b in pairs]
    inner = y.columns if keep else [c for c in y.columns if c not in keys]
    own = y.ordered() if y.order else y
    fields = [quoted(o) for o, _ in own.order] + [F.struct(*map(quoted, inner)).alias("v")]
    rows = F.collect_list(F.struct(*fields)) if own.order else F.collect_list(fields[0])
    gathered = F.transform(F.array_sort(rows), lambda r: r.getField("v")) if own.order else rows
    nested = own.df.groupBy(*[quoted(b).alias(f"__y_{b}") for b in keys]).agg(gathered.alias(name))
    tests = [quoted(a).eqNullSafe(F.col(f"`__y_{b}`")) if na_matches == "na" else quoted(a) == F.col(f"`__y_{b}`") for a, b in pairs]
    joined = x.df.join(nested, reduce(lambda p, q: p & q, tests), "left")
    empty = F.array().cast(nested.schema[name].dataType)
    return x.with_(joined.select(*[quoted(c) for c in x.columns], F.coalesce(quoted(name), empty).alias(name), *map(quoted, x.hidden)))


@verb(tables=2)
def cross_join(x, y, copy=False, suffix=("_x", "_y")):
    """Every row of x with every row of y."""
    both = set(x.columns) & set(y.columns)
    ordered = bool(x.order or y.order)
    if ordered:
        x, y = x.ordered(), y.ordered()
    joined = prefixed(x, "x").crossJoin(prefixed(y, "y"))
    columns = [F.col(f"`__{s}_{c}`").alias(c + suffix[i] if c in both else c) for i, (s, fr) in enumerate((("x", x), ("y", y))) for c in fr.columns]
    order = []
    if ordered:
        for s, fr in (("x", x), ("y", y)):
            for i, (o, d) in enumerate(fr.order):
                columns.append(F.col(f"`__{s}_{o}`").alias(f"__o{s}{i}"))
                order.append((f"__o{s}{i}", d))
    return Frame(joined.select(*columns), groups=[g for g in x.groups if g not in both], order=order)


# ---------------------------------------------------------------- row modifications
def row_keys(x: Frame, y: Frame, by) -> list[str]:
    keys = [a for a, _ in join_keys(x, y, by if by is not None else y.columns[0])]
    unknown = [c for c in y.columns if c not in x.columns]
    if unknown:
        raise ValueError(f"columns {unknown} of y are not in x")
    return keys


def unique_keys(y: Frame, keys: list[str]) -> None:
    if not y.df.groupBy(*map(quoted, keys)).count().where("count > 1").isEmpty():
        raise ValueError("keys of y are not unique")


def same_keys(keys: list[str]) -> Column:
    return reduce(lambda p, q: p & q, [F.col(f"`__x_{k}`").eqNullSafe(F.col(f"`__y_{k}`")) for k in keys])


def unmatched_error(x: Frame, y: Frame, keys: list[str], unmatched: str) -> None:
    if unmatched == "error" and not prefixed(y, "y").join(prefixed(x, "x"), same_keys(keys), "left_anti").isEmpty():
        raise ValueError("keys of y are missing in x")


def stacked(x: Frame, y: Frame) -> Frame:
    """Rows of y behind those of x."""
    from verbena.operators.sets import bind_rows

    out = bind_rows.run(x.with_(groups=[]), y.with_(groups=[]))
    return out.keep(*map(quoted, x.columns)).with_(groups=x.groups)


def unmatched_rows(x: Frame, y: Frame, keys: list[str]) -> Frame:
    return filtering(y, x, keys, "na", "left_anti")


@verb(tables=2)
def rows_insert(x, y, by=None, conflict="error", **kwargs):
    """Rows of y added; keys that x has are an error or ignored."""
    keys = row_keys(x, y, by)
    if conflict == "error" and not filtering(y, x, keys, "na", "left_semi").df.isEmpty():
        raise ValueError("keys of y are in x already")
    return stacked(x, unmatched_rows(x, y, keys))


def updated(x: Frame, y: Frame, keys: list[str], patch: bool) -> Frame:
    joined = prefixed(x, "x").join(prefixed(y, "y").withColumn("__hit", F.lit(True)), same_keys(keys), "left")
    columns = []
    for c in x.columns:
        old, new = F.col(f"`__x_{c}`"), F.col(f"`__y_{c}`") if c in y.columns and c not in keys else None
        if new is None:
            columns.append(old.alias(c))
        else:
            columns.append((F.coalesce(old, new) if patch else F.when(F.col("__hit"), new).otherwise(old)).cast(x.dtype(c)).alias(c))
    return x.with_(joined.select(*columns, *[F.col(f"`__x_{h}`").alias(h) for h in x.hidden]))


@verb(tables=2)
def rows_update(x, y, by=None, unmatched="error", **kwargs):
    """Values of x overwritten where keys match."""
    keys = row_keys(x, y, by)
    unique_keys(y, keys)
    unmatched_error(x, y, keys, unmatched)
    return updated(x, y, keys, False)


@verb(tables=2)
def rows_patch(x, y, by=None, unmatched="error", **kwargs):
    """Missing values of x filled where keys match."""
    keys = row_keys(x, y, by)
    unique_keys(y, keys)
    unmatched_error(x, y, keys, unmatched)
    return updated(x, y, keys, True)


@verb(tables=2)
def rows_upsert(x, y, by=None, **kwargs):
    """Matched rows updated, others inserted."""
    keys = row_keys(x, y, by)
    unique_keys(y, keys)
    return stacked(updated(x, y, keys, False), unmatched_rows(x, y, keys))


@verb(tables=2)
def rows_delete(x, y, by=None, unmatched="error", **kwargs):
    """Rows of x whose keys are in y removed."""
    keys = [a for a, _ in join_keys(x, y, by if by is not None else y.columns[0])]
    unmatched_error(x, y, keys, unmatched)
    return filtering(x, y, keys, "na", "left_anti")


@verb(tables=2)
def rows_append(x, y, **kwargs):
    """Rows of y behind those of x, whatever their keys."""
    unknown = [c for c in y.columns if c not in x.columns]
    if unknown:
        raise ValueError(f"columns {unknown} of y are not in x")
    return stacked(x, y)
