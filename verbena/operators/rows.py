"""Filtering, ordering, slicing, distinct rows and sampling."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbena.expr import Call, Col, Expr, Op, Range, RangeList, function, verb
from verbena.frame import Context, Frame, Val, group_positions, literal, quoted
from verbena.functions.aggregate import na
from verbena.functions.random import next_seed
from verbena.functions.window import counted_ranks
from verbena.operators.mutate import computed, expanded, without_scratch
from verbena.operators.select import resolve

#: Draws with putting back that are numbered at once.
DRAWS = 10_000


def _desc_plain(x):
    return sorted(x, reverse=True) if isinstance(x, (list, tuple)) else -x


@function("special", eager=_desc_plain)
def desc(ctx, x):
    """Descending order, in ``arrange`` and in rankings."""
    return -ctx.val(x).col


@verb
def filter_(_data, *conditions, _preserve=False):
    """Keep rows for which all conditions hold; aggregates are those of the group."""
    ctx = Context(_data)
    tests: list[Column] = []
    for x in conditions:
        if isinstance(x, (list, tuple)):
            from verbena.operators.mutate import listed

            ctx.frame = listed(ctx.frame, list(x), None)("__keep")
            tests.append(quoted("__keep"))
            continue
        v = ctx.val(x)
        test = v.col.cast("boolean")
        tests.append(ctx.hoist(test) if v.window else test)
    df = ctx.frame.df
    for t in tests:
        df = df.where(t)
    out = without_scratch(ctx.frame.with_(df))
    return out.with_(out.df.drop("__keep")) if "__keep" in out.df.columns else out


@verb
def arrange(_data, *args, _by_group=False, **kwargs):
    """Order rows; missing values come last, descending or not."""
    keys: list[tuple[str, bool]] = []
    frame = _data
    exprs = [(None, Col(g)) for g in _data.groups] if _by_group else []
    for name, x in exprs + expanded(_data, args, kwargs):
        down = False
        while isinstance(x, Call) and x.name == "desc":
            x, down = x.args[0], not down
        ctx = Context(frame)
        if isinstance(x, (Col, str)):
            v = ctx.column(x if isinstance(x, str) else x.name)
            from verbena.frame import factor_rank

            key = factor_rank(v)
        else:
            key = ctx.val(x).col
        hidden = f"__k{sum(c.startswith('__k') for c in frame.df.columns)}"
        frame = ctx.frame.with_(ctx.frame.df.withColumn(hidden, key))
        keys.append((hidden, down))
    ties = [o for o in _data.order if o[0] not in [k for k, _ in keys]]
    return without_scratch(frame).with_(order=keys + ties)


# ---------------------------------------------------------------- slices
def row_position(frame: Frame, reverse: bool = False) -> tuple[Frame, Column]:
    """The 0-based position of each row in its group."""
    own = frame.ordered()
    if own.groups:
        made = None if reverse else group_positions(own, [(quoted(o), d) for o, d in own.order], "__at0")
        if made is not None:
            return own.with_(made), quoted("__at0")
        window = Window.partitionBy(*map(quoted, own.groups)).orderBy(*own.sort_columns(reverse))
        return own, (F.row_number().over(window) - 1).cast("bigint")
    out = own.ordinal("__at0").with_(order=own.order)
    if reverse:
        ctx = Context(out)
        last = ctx.over_group(F.max("__at0"))
        return ctx.frame, last - quoted("__at0")
    return out, quoted("__at0")


def kept(frame: Frame, test: Column) -> Frame:
    """Rows for which a test over windows holds."""
    df = frame.df.withColumn("__keep", test).where("__keep").drop("__keep", "__at0")
    return without_scratch(frame.with_(df))


def position_test(ctx: Context, x: Any, at: Column, size: Column) -> Column:
    """Whether a row's position is among those that an argument of ``slice_`` names."""
    if isinstance(x, Op) and x.symbol in ("~", "neg") and not isinstance(x.args[0], (int, float)):
        return ~position_test(ctx, x.args[0], at, size)
    if isinstance(x, RangeList):
        return position_test(ctx, x.source, at, size)
    if isinstance(x, (slice, Range)):
        out = F.lit(False)
        for p in x.parts if isinstance(x, Range) else (x,):
            if not isinstance(p, slice):
                out = out | position_test(ctx, p, at, size)
                continue
            start = from_end(ctx, 0 if p.start is None else p.start, size)
            inside = at >= start
            if p.stop is not None:
                stop = from_end(ctx, p.stop, size)
                inside = inside & ((at <= stop) if p.step is not None else (at < stop))
            if p.step is not None and p.step != 1:
                inside = inside & ((at - start) % F.lit(abs(p.step)) == 0)
            out = out | inside
        return out
    if isinstance(x, (list, tuple, range, set)):
        out = F.lit(False)
        for v in x:
            out = out | position_test(ctx, v, at, size)
        return out
    return at == from_end(ctx, x, size)


def from_end(ctx: Context, x: Any, size: Column) -> Column:
    if isinstance(x, int):
        return F.lit(x).cast("bigint") if x >= 0 else size + x
    v = ctx.val(x)
    col = ctx.hoist(v.col) if v.window else v.col
    return F.when(col < 0, size + col).otherwise(col)


@verb
def slice_(_data, *args, _preserve=False):
    """Rows by 0-based position in their group; negative positions count from the end, ``~`` and
    ``-`` exclude."""
    frame, at = row_position(_data)
    ctx = Context(frame)
    at = ctx.hoist(at)
    size = group_size_of(ctx)
    test = F.lit(False)
    for x in args:
        test = test | position_test(ctx, x, at, size)
    return kept(ctx.frame, test)


def group_size_of(ctx: Context) -> Column:
    """Rows of the group beside each row."""
    size = ctx.over_group(F.count(F.lit(1)))
    return ctx.hoist(size) if ctx.frame.groups else size


def amount(n, prop, default=1) -> tuple[Any, Any]:
    if n is not None and prop is not None:
        raise ValueError("only one of n and prop can be given")
    return (default if n is None and prop is None else n), prop


def edge(_data: Frame, n, prop, tail: bool) -> Frame:
    n, prop = amount(n, prop)
    if prop is None and not _data.groups and n >= 0:
        own = _data.ordered()
        rows = own.df.orderBy(*own.sort_columns(tail)).limit(n) if tail or _data.order else own.df.limit(n)
        return own.with_(rows)
    frame, at = row_position(_data, tail)
    ctx = Context(frame)
    at = ctx.hoist(at)
    if prop is None and n >= 0:
        return kept(ctx.frame, at < n)
    size = group_size_of(ctx)
    return kept(ctx.frame, at < (size + n if prop is None else F.floor(size * prop)))


@verb
def slice_head(_data, n=None, prop=None):
    """The first rows of each group; a share is rounded down."""
    return edge(_data, n, prop, False)


@verb
def slice_tail(_data, n=None, prop=None):
    """The last rows of each group."""
    return edge(_data, n, prop, True)


def extreme(_data: Frame, order_by, n, prop, with_ties, down: bool) -> Frame:
    ctx = Context(_data)
    value = ctx.row(order_by)
    key = value.desc_nulls_last() if down else value.asc_nulls_last()
    with_ties = True if with_ties is None else with_ties
    parts = ctx.partition()
    if not parts and with_ties is True:
        rank = counted_ranks(ctx, value, down, "bottom")["rank"]
    elif not parts and prop is None:
        keys = [key, *ctx.order_columns(reverse=with_ties == "last")]
        return without_scratch(ctx.frame.with_(ctx.df.orderBy(*keys).limit(n)))
    elif with_ties is True:
        rank = F.rank().over(Window.partitionBy(*parts).orderBy(key))
    elif parts:
        rank = F.row_number().over(Window.partitionBy(*parts).orderBy(key, *ctx.order_columns(reverse=with_ties == "last")))
    else:
        rest = [Call("desc", (Val(c),)) if d != (with_ties == "last") else Val(c) for c, d in ctx.order_keys()]
        ctx.explicit_order = [Call("desc", (Val(value),)) if down else Val(value), *rest]
        rank = ctx.position() + 1
        ctx.explicit_order = None
    if prop is None:
        most = F.lit(n)  # known before the shuffle: a group limit
    else:
        most = F.floor(group_size_of(ctx) * prop)
    frame = ctx.frame.with_(ctx.frame.df.withColumn("__rank", rank))
    df = frame.df.where(F.col("__rank") <= most)
    order = [("__rank", False), *[o for o in frame.order]]
    return without_scratch(frame.with_(df, order=order))


@verb
def slice_min(_data, order_by, n=1, prop=None, with_ties=None):
    """Rows with the least values; with ties unless told otherwise."""
    return extreme(_data, order_by, n, prop, with_ties, False)


@verb
def slice_max(_data, order_by, n=1, prop=None, with_ties=None):
    """Rows with the greatest values."""
    return extreme(_data, order_by, n, prop, with_ties, True)


def draws_of(groups: DataFrame, names: list[str], total: Column, seed: int) -> DataFrame:
    """One row for each draw with putting back: the group, its number __i, and __even between 0 and 1
    that depends on both alone. They are numbered in pieces, dealt over the tasks; as plans take them
    to be as few as the groups, joins must not broadcast them."""
    last = total.cast("bigint")
    pieces = groups.where(total > 0).withColumn("__piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((last - 1) / DRAWS).cast("bigint"))))
    pieces = pieces.repartition(int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    draws = pieces.withColumn("__i", F.explode(F.sequence(F.col("__piece") * DRAWS + 1, F.least(last, (F.col("__piece") + 1) * DRAWS))))
    bits = F.xxhash64(F.lit(seed), F.lit("draw"), F.col("__i"), *map(quoted, names))
    return draws.withColumn("__even", (F.pmod(bits, F.lit(1 << 52)) + 0.5) / float(1 << 52))


@verb
def slice_sample(_data, n=1, prop=None, weight_by=None, replace=False, random_state=None):
    """Rows at random, per group; with weights by exponential keys; with putting back every
    draw is a position."""
    seed = next_seed() if random_state is None else random_state
    own = _data.ordered()
    ctx = Context(own)
    if not replace:
        # of the row's place (or content) alone, so that two branches of a plan draw alike
        even = (F.pmod(F.xxhash64(F.lit(seed), *[c for c, _ in ctx.order_keys()]), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        key = even if weight_by is None else -F.log(even) / ctx.row(weight_by).cast("double")
        frame = ctx.frame.with_(ctx.frame.df.withColumn("__draw", key))
        if prop is None and not _data.groups:
            return own.with_(frame.df.orderBy("__draw").limit(n).drop("__draw"))
        if not _data.groups:  # a share of all rows: positions in the order of the draws
            ctx = Context(frame.with_(order=[("__draw", False)]).ordinal("__at0").with_(order=own.order))
            size = group_size_of(ctx)
            out = kept(ctx.frame, F.col("__at0") < F.floor(size * prop))
            return out.with_(out.df.drop("__draw"))
        window = Window.partitionBy(*map(quoted, _data.groups)).orderBy("__draw")
        ctx = Context(frame)
        at = ctx.hoist(F.row_number().over(window))
        size = group_size_of(ctx)
        out = kept(ctx.frame, at <= (F.floor(size * prop) if prop is not None else F.lit(n)))
        return out.with_(out.df.drop("__draw"))
    if weight_by is None:  # every draw is a position
        own, at = row_position(own)
        frame = own.with_(own.df.withColumn("__place", at))
        groups = frame.df.groupBy(*map(quoted, _data.groups)).agg(F.count("*").alias("__size"))
        total = F.lit(n) if prop is None else F.floor(F.col("__size") * prop)
        draws = draws_of(groups, _data.groups, total, seed)
        draws = draws.select(*[quoted(g).alias(f"__of_{g}") for g in _data.groups], F.floor(F.col("__even") * F.col("__size")).alias("__drawn"))
        same = F.col("__place") == F.col("__drawn")
        for g in _data.groups:
            same = same & quoted(g).eqNullSafe(quoted(f"__of_{g}"))
        out = frame.df.join(draws.hint("merge"), same).select(*[quoted(c) for c in own.df.columns if c != "__at0"])
        return own.with_(out)
    frame = ctx.frame.with_(ctx.frame.df.withColumn("__w", ctx.row(weight_by).cast("double")))
    # every draw is a point on the line of the weights; the line is cut into cells as long as the
    # mean weight, so that points and rows meet by cell
    ctx = Context(frame)
    at = ctx.hoist(ctx.running_value(F.sum, quoted("__w"), lambda a, b: F.coalesce(a, F.lit(0.0)) + b))
    frame = ctx.frame.with_(ctx.frame.df.withColumn("__to", at))
    groups = frame.df.groupBy(*map(quoted, _data.groups)).agg(F.sum("__w").alias("__all"), F.count("*").alias("__size")).where("__all > 0")
    total = F.lit(n) if prop is None else F.floor(F.col("__size") * prop)
    of = [quoted(g).alias(f"__of_{g}") for g in _data.groups]
    same = F.lit(True)
    for g in _data.groups:
        same = same & quoted(g).eqNullSafe(quoted(f"__of_{g}"))
    step = F.col("__all") / F.col("__size")
    draws = draws_of(groups, _data.groups, total, seed).withColumn("__u", F.col("__even") * F.col("__all"))
    draws = draws.select(*of, "__i", "__u", F.floor(F.col("__u") / step).alias("__cell"))
    rows = frame.df.where("__w > 0").join(groups.select(*of, step.alias("__step")), same)
    rows = rows.drop(*[f"__of_{g}" for g in _data.groups]).withColumn("__cell", F.explode(F.sequence(F.floor((F.col("__to") - F.col("__w")) / F.col("__step")), F.floor(F.col("__to") / F.col("__step")))))
    met = rows.alias("r").join(draws.hint("merge").alias("d"), same & (F.col("r.__cell") == F.col("d.__cell")) & F.expr("__u < __to and __u >= __to - __w"))
    return own.with_(met.select(*[F.col(f"r.`{c}`") for c in own.df.columns]))


@verb(plain=1)
def head(x, n=6):
    """The first rows, or elements."""
    if not isinstance(x, Frame):
        return list(x)[:n]
    return edge(x.with_(groups=[]), n, None, False).with_(groups=x.groups)


@verb(plain=1)
def tail(x, n=6):
    """The last rows, or elements."""
    if not isinstance(x, Frame):
        return list(x)[-n:] if n else []
    return edge(x.with_(groups=[]), n, None, True).with_(groups=x.groups)


# ---------------------------------------------------------------- distinct rows
@verb
def distinct(_data, *args, keep_all=False, _keep_all=None, _preserve=False, **kwargs):
    """Unique rows over some columns or expressions; the first of each in row order."""
    keep_all = keep_all if _keep_all is None else _keep_all
    if not args and not kwargs:
        names = _data.columns
        if not _data.order:
            return _data.with_(_data.df.select(*map(quoted, names)).distinct())
        frame = _data
    else:
        frame = _data
        names = list(_data.groups)
        for name, x in expanded(_data, args, kwargs):
            if isinstance(x, (Col, str)) or (isinstance(x, Expr) and name not in kwargs and not isinstance(x, (Op,)) and is_selector(x)):
                names += resolve(_data, x)
            else:
                frame = computed(frame, name, x)
                names.append(name)
        names = list(dict.fromkeys(names))
        if not keep_all and not _data.order:
            return frame.with_(frame.df.select(*map(quoted, names)).distinct())
    own = frame.ordered()
    window = Window.partitionBy(*map(quoted, names)).orderBy(*own.sort_columns())
    df = own.df.withColumn("__n", F.row_number().over(window)).where("__n = 1").drop("__n")
    out = without_scratch(own.with_(df))
    return out if keep_all else out.keep(*map(quoted, names))


def is_selector(x: Any) -> bool:
    from verbena.expr import FUNCTIONS

    return isinstance(x, Call) and (FUNCTIONS[x.name].kind == "select" or x.name == "c_") or isinstance(x, Range)


@verb(plain=1)
def unique(x):
    """Distinct rows of a frame, distinct elements of a vector, in their order."""
    if isinstance(x, Frame):
        return distinct.run(x)
    from verbena.functions.scalar import _unique

    return _unique(x)


@verb
def drop_na(_data, *columns, _how="any", how_=None):
    """Drop rows with missing values in any (or all) of some columns."""
    how = how_ or _how
    names = list(dict.fromkeys(n for c in columns for n in resolve(_data, c))) or _data.columns
    ctx = Context(_data)
    test = None
    for n in names:
        good = ~na(ctx, quoted(n))
        test = good if test is None else (test & good if how == "any" else test | good)
    return _data.with_(_data.df.where(test))


@verb
def uncount(data, weights, _remove=True, _id=None):
    """Rows repeated by a weight; ``_id`` numbers the copies from 0."""
    ctx = Context(data)
    n = ctx.col(weights).cast("int")
    frame = ctx.frame.ordered() if data.order else ctx.frame
    df = frame.df.withColumn("__n", n).select("*", F.posexplode(F.expr("array_repeat(1, __n)")).alias("__copy", "__one")).drop("__one", "__n")
    gone = [weights.name] if _remove and isinstance(weights, Col) else []
    columns = [quoted(c) for c in data.columns if c not in gone] + ([F.col("__copy").cast("bigint").alias(_id)] if _id else [])
    hidden = [h for h in frame.hidden if h != "__copy"]
    return frame.with_(df.select(*columns, *map(quoted, hidden), "__copy"), order=[*frame.order, ("__copy", False)] if frame.order else [])


@verb
def replace_na(data, data_or_replace=None, replace=None):
    """Missing values replaced: by a mapping of columns, or one value for all that fit it."""
    value = replace if replace is not None else data_or_replace
    if not isinstance(data, Frame):
        raise TypeError("a frame is needed")
    if not isinstance(value, dict):
        value = dict.fromkeys(data.columns, value)
    ctx = Context(data)
    columns = []
    for c in data.columns:
        if c in value:
            columns.append(F.when(na(ctx, quoted(c)), literal(value[c]).try_cast(data.dtype(c))).otherwise(quoted(c)).alias(c))
        else:
            columns.append(quoted(c))
    return data.keep(*columns)
