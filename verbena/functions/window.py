"""Ranking, offset and cumulative functions: windows over the group, in row order or by a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verbena.expr import Call, Symbol, f, function
from verbena.frame import Context, Frame, Val, large_groups, range_number


def rank_key(ctx: Context, x) -> tuple[Column, bool]:
    """What is ranked, and whether from the greatest."""
    ctx.no_stream()
    down = isinstance(x, Call) and x.name == "desc"
    value = ctx.row(x.args[0] if down else x)
    return value, down


def grouped_ranks(ctx: Context, value: Column, down: bool, na_last: str) -> dict:
    """Ranks inside groups, all over one window: missing values are behind (before, for ``top``)
    the others and count only where they are ranked."""
    parts = ctx.partition()
    first = na_last == "top"
    key = (value.desc_nulls_first() if first else value.desc_nulls_last()) if down else (value.asc_nulls_first() if first else value.asc_nulls_last())
    window = Window.partitionBy(*parts).orderBy(key)
    seen = F.count(value) if na_last == "keep" else F.count(F.lit(1))
    return {
        "rank": F.rank().over(window).cast("bigint"),
        "dense": F.dense_rank().over(window).cast("bigint"),
        "upto": seen.over(window.rangeBetween(Window.unboundedPreceding, Window.currentRow)),
        "number": F.row_number().over(window).cast("bigint"),
        "all": seen.over(Window.partitionBy(*parts)),
    }


def counted_ranks(ctx: Context, value: Column, down: bool, na_last: str) -> dict:
    """Ranks over a whole table, or in groups of which some are large: values are counted, the
    distinct ones numbered by ranges, and joined back, so that neither the rows nor those of a group
    or of a frequent value come together. All ranks of one value in a verb share the numbers."""
    mark = f"ranks of {value} {down} {na_last} in {ctx.frame.groups}"
    if mark not in ctx.frame.known:
        frame, parts = ctx.frame, ctx.partition()
        of = [f"__g{i}" for i in range(len(parts))]
        counted = frame.source(value, *parts).select(*[g.alias(n) for g, n in zip(parts, of, strict=True)], value.alias("__v")).groupBy(*of, "__v").agg(F.count("*").alias("__c"))
        order = [(n, False) for n in of]
        if na_last == "keep":
            counted = counted.where("__v is not null")
        if na_last == "top":
            counted, order = counted.withColumn("__n", F.col("__v").isNotNull()), [*order, ("__n", False)]
        table = running_counts(Frame(counted, order=[*order, ("__v", down)]), of)
        same = value.eqNullSafe(F.col("__v"))
        for g, n in zip(parts, of, strict=True):
            same = same & g.eqNullSafe(F.col(n))
        own = frame.df.join(table, same, "left")
        if not parts:
            own = own.join(F.broadcast(counted.agg(F.coalesce(F.sum("__c"), F.lit(0)).alias("__all"))))
        first = int(ctx.fresh()[3:])
        names = [f"__t{first + i}" for i in range(4)]
        df = own.select(*[F.col(f"`{c}`") for c in frame.df.columns], *[F.col(o).alias(n) for o, n in zip(("__upto", "__dense", "__c", "__all"), names, strict=True)])
        ctx.frame = frame.added(df, **{mark: tuple(names)})
    upto, dense, count, every = (F.col(n) for n in ctx.frame.known[mark])
    return {"rank": upto - count + 1, "dense": dense, "upto": upto, "all": every}


def running_counts(counted: Frame, of: list[str]) -> DataFrame:
    """Of every value (in its group, whose columns are ``of``): __c, the running sum of it (__upto) and
    number of values (__dense); with groups the sum of all (__all) too."""
    if not of:
        inner = Context(counted)
        add = lambda a, b: F.coalesce(a, F.lit(0)) + b
        upto = inner.hoist(inner.running_value(F.sum, F.col("__c"), add))
        dense = inner.hoist(inner.running_value(F.sum, F.lit(1).cast("bigint"), add))
        return inner.df.select("__v", "__c", upto.alias("__upto"), dense.alias("__dense"))
    order = counted.sort_columns()[len(of) :]
    part = range_number(counted.df, [(F.col(n), d) for n, d in counted.order])
    window = Window.partitionBy(*([] if part is None else ["__pid"]), *of).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto, dense = F.sum("__c").over(window), F.count(F.lit(1)).over(window)
    if part is None:
        return counted.df.select(*of, "__v", "__c", upto.alias("__upto"), dense.alias("__dense"), F.sum("__c").over(Window.partitionBy(*of)).alias("__all"))
    inside = counted.df.withColumn("__pid", part).select("__pid", *of, "__v", "__c", upto.alias("__u"), dense.alias("__d"))
    # of every range and group, what lies in the ranges before
    each = counted.df.select(part.alias("__of"), *[F.col(n).alias(f"__of_{n}") for n in of], "__c").groupBy("__of", *[f"__of_{n}" for n in of]).agg(F.sum("__c").alias("__su"), F.count(F.lit(1)).alias("__sd"))
    groups = Window.partitionBy(*[f"__of_{n}" for n in of])
    ahead = groups.orderBy("__of").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.select("__of", *[f"__of_{n}" for n in of], (F.sum("__su").over(ahead) - F.col("__su")).alias("__bu"), (F.sum("__sd").over(ahead) - F.col("__sd")).alias("__bd"), F.sum("__su").over(groups).alias("__all"))
    same = F.col("__pid") == F.col("__of")
    for n in of:
        same = same & F.col(n).eqNullSafe(F.col(f"__of_{n}"))
    return inside.join(each, same).select(*of, "__v", "__c", (F.col("__bu") + F.col("__u")).alias("__upto"), (F.col("__bd") + F.col("__d")).alias("__dense"), "__all")


def ranks_of(ctx: Context, value: Column, down: bool, na_last: str) -> dict:
    """Ranks by windows where every group fits a task, else by counts of the values."""
    if not ctx.frame.groups:
        return counted_ranks(ctx, value, down, na_last)
    parts = ctx.partition()
    mark = f"large groups of {ctx.frame.groups}"
    if mark not in ctx.frame.known:
        ctx.frame = ctx.frame.added(ctx.df, **{mark: () if large_groups(ctx.frame.source(*parts), parts) else None})
    plain = any(isinstance(x.dataType, (T.StructType, T.ArrayType, T.MapType)) for x in ctx.df.select(value.alias("v"), *parts).schema)
    return (grouped_ranks if plain or ctx.frame.known[mark] is None else counted_ranks)(ctx, value, down, na_last)


#: From the parts of ``grouped_ranks``.
RANKS = {
    "min_rank": lambda r: r["rank"],
    "dense_rank": lambda r: r["dense"],
    "percent_rank": lambda r: F.when(r["all"] > 1, (r["rank"] - 1) / (r["all"] - 1).cast("double")).otherwise(0.0),
    "cume_dist": lambda r: r["upto"] / r["all"].cast("double"),
}


def ranking(name: str):
    def lower(ctx, x=f, *, na_last="keep"):
        if na_last not in ("keep", "top", "bottom"):
            raise ValueError("na_last is keep, top or bottom")
        if isinstance(x, Symbol):
            value, down = row_order(ctx), False
        else:
            value, down = rank_key(ctx, x)
        out = RANKS[name](ranks_of(ctx, value, down, na_last))
        return Val(F.when(value.isNotNull(), out) if na_last == "keep" else out, "row", True)

    lower.__doc__ = f"{name} of the values inside the group; missing ones by ``na_last``."
    function("window", f"{name}_", always=False)(lower)
    return function("window", name, always=True, eager=lambda x=f, **k: _eager(name, x, k))(lower)


def _eager(name, x, kwargs):
    if isinstance(x, Symbol) or not isinstance(x, (list, tuple, range)):
        return Call(name, (x,), kwargs)
    from verbena.expr import FUNCTIONS
    from verbena.frame import evaluate

    return evaluate(FUNCTIONS[name], (x,), kwargs)


def row_order(ctx: Context):
    """The row order as one column."""
    from verbena.functions.aggregate import order_key

    return order_key(ctx, None)


min_rank, dense_rank, percent_rank, cume_dist = map(ranking, RANKS)


def number_by(ctx: Context, x) -> Column:
    """1-based number of each row in the order of a key."""
    if isinstance(x, Symbol):
        return ctx.position() + 1
    before, ctx.explicit_order = ctx.explicit_order, [x]
    try:
        return ctx.position() + 1
    finally:
        ctx.explicit_order = before


def _row_number(ctx, x=f):
    """1-based number of the row by ``x``, else in row order."""
    return Val(number_by(ctx, x), "row", True)


row_number_ = function("window", "row_number_")(_row_number)
row_number = function("window", "row_number", always=True)(_row_number)


def _ntile(ctx, x=f, *, n=None):
    """1-based buckets of about equal size, larger ones first; missing values have none."""
    value = None if isinstance(x, Symbol) else rank_key(ctx, x)[0]
    at = ctx.hoist(number_by(ctx, x)) - 1
    seen = F.count(F.lit(1) if value is None else value)
    size = ctx.hoist(seen.over(Window.partitionBy(*ctx.partition()))) if ctx.frame.groups else ctx.over_group(seen)
    small, more = F.floor(size / n).cast("bigint"), (size % n).cast("bigint")
    wide = more * (small + 1)
    out = F.when(at < wide, F.floor(at / (small + 1)) + 1).otherwise(more + F.floor((at - wide) / F.greatest(small, F.lit(1))) + 1).cast("bigint")
    return Val(out if value is None else F.when(value.isNotNull(), out), "row", True)


ntile_ = function("window", "ntile_")(_ntile)
ntile = function("window", "ntile", always=True)(_ntile)
for _name in ("min_rank", "dense_rank", "percent_rank", "cume_dist"):
    from verbena.expr import FUNCTIONS as _F

    globals()[f"{_name}_"] = _F[f"{_name}_"]


@function("window")
def rank(ctx, x, na_last=True, ties_method="average"):
    """Ranks with a choice for ties: average, first, last, random, max or min."""
    value, down = rank_key(ctx, x)
    missing = na_last if na_last == "keep" else "bottom" if na_last else "top"
    if ties_method in ("average", "min", "max"):
        r = ranks_of(ctx, value, down, missing)
        out = (r["rank"] + r["upto"]) / F.lit(2.0) if ties_method == "average" else (r["rank"] if ties_method == "min" else r["upto"])
        return Val(F.when(value.isNotNull(), out) if missing == "keep" else out, "row", True)
    value = ctx.hoist(value)
    ctx.frame = ctx.frame.ordered()
    if ties_method == "random":
        rest = [Val(ctx.hoist(F.xxhash64(F.lit(_seed()), *[c for c, _ in ctx.order_keys()])))]
    else:
        rest = [Call("desc", (Val(c),)) if d != (ties_method == "last") else Val(c) for c, d in ctx.order_keys()]
    first = [Val(F.when(value.isNull(), 0).otherwise(1))] if missing == "top" else []
    held, ctx.explicit_order = ctx.explicit_order, [*first, Call("desc", (Val(value),)) if down else Val(value), *rest]
    try:
        out = ctx.position() + 1
    finally:
        ctx.explicit_order = held
    return Val(F.when(value.isNotNull(), out) if missing == "keep" else out, "row", True)


def _seed() -> int:
    from verbena.functions.random import next_seed

    return next_seed()


@function("window")
def consecutive_id(ctx, x, *more):
    """Number of the run, from 1; a run ends when any argument changes."""
    changed, inner = F.lit(False), F.lit(True)
    for v in [ctx.row(v) for v in (x, *more)]:
        before, inner = ctx.shifted(v, 1, True)
        changed = changed | ~v.eqNullSafe(before)
    flag = ctx.hoist(F.when(changed & inner, 1).otherwise(0).cast("bigint"))
    return Val(ctx.running_value(F.sum, flag, lambda a, b: F.coalesce(a, F.lit(0)) + b).cast("bigint") + 1, "row", True)


def moved(ctx, x, n, default, order_by, back: bool) -> Val:
    value = ctx.row(x)
    held, ctx.explicit_order = ctx.explicit_order, [order_by] if order_by is not None else ctx.explicit_order
    try:
        out, there = ctx.shifted(value, n, back) if n > 0 else (value, F.lit(True))
    finally:
        ctx.explicit_order = held
    if default is not None:  # a missing value inside stays missing
        out = F.when(~there, ctx.col(default).cast(ctx.dtype(value))).otherwise(out)
    return Val(out, "row", True)


@function("window")
def lead(ctx, x, n=1, default=None, order_by=None):
    """The value n rows ahead."""
    return moved(ctx, x, n, default, order_by, False)


@function("window")
def lag(ctx, x, n=1, default=None, order_by=None):
    """The value n rows back."""
    return moved(ctx, x, n, default, order_by, True)


#: How an aggregate of the rows before a range and one of its own rows make one.
MERGE = {
    F.sum: lambda a, b: F.coalesce(a + b, a, b),
    F.product: lambda a, b: F.coalesce(a * b, a, b),
    F.min: F.least,
    F.max: F.greatest,
    F.bool_and: lambda a, b: F.coalesce(a & b, a, b),
    F.bool_or: lambda a, b: F.coalesce(a | b, a, b),
}


def cumulative(name: str, make):
    def lower(ctx, x, *args, **kwargs):
        value = ctx.row(x)
        out = ctx.running_value(make, value, MERGE[make])
        return Val(F.when(value.isNotNull(), out), "row", True)

    lower.__doc__ = f"Cumulative {name[3:]} in row order; missing values are skipped and stay missing."
    return function("window", name)(lower)


cumsum = cumulative("cumsum", F.sum)
cumprod = cumulative("cumprod", F.product)
cummin = cumulative("cummin", F.min)
cummax = cumulative("cummax", F.max)


@function("window")
def cummean(ctx, x, na_rm=False):
    """Cumulative mean; from a missing value on it is missing unless ``na_rm``."""
    value = ctx.row(x)
    if ctx.range_column() is None:
        out = F.avg(value).over(ctx.running())
    else:
        total = ctx.hoist(ctx.running_value(F.sum, value.cast("double"), MERGE[F.sum]))
        out = total / ctx.hoist(ctx.running_value(F.sum, F.when(value.isNotNull(), F.lit(1)).otherwise(0), MERGE[F.sum]))
    if na_rm:
        return Val(out, "row", True)
    out = ctx.hoist(out)
    return Val(F.when(~ctx.running_value(F.bool_or, value.isNull(), MERGE[F.bool_or]), out), "row", True)


def until(ctx, x, stop, name: bool):
    """``name`` from where a value settles the answer, the opposite while none is missing."""
    value = ctx.row(x).cast("boolean")
    settled = ctx.hoist(ctx.running_value(stop, value, MERGE[stop]))
    gap = ctx.running_value(F.bool_or, value.isNull(), MERGE[F.bool_or])
    return Val(F.when(F.coalesce(settled == F.lit(name), F.lit(False)), F.lit(name)).when(~gap, F.lit(not name)), "row", True)


@function("window")
def cumall(ctx, x):
    """True up to the first false value."""
    return until(ctx, x, F.bool_and, False)


@function("window")
def cumany(ctx, x):
    """True from the first true value on."""
    return until(ctx, x, F.bool_or, True)


def _diff_plain(x, lag=1, differences=1):
    x = list(x)
    for _ in range(differences):
        x = [None if a is None or b is None else b - a for a, b in zip(x, x[lag:], strict=False)]
    return x


@function("window", eager=_diff_plain)
def diff(ctx, x, lag=1, differences=1):
    """Differences to the value ``lag`` rows back, as often as ``differences`` says. On vectors
    the result is shorter; in a frame the first rows are missing."""
    value = ctx.row(x)
    for _ in range(differences):
        value = ctx.hoist(value - ctx.shifted(value, lag, True)[0])
    return Val(value, "row", True)


@function("window")
def scale(ctx, x, center=True, scale_=True):
    """Values minus their mean (or ``center``), by their standard deviation (or ``scale_``)."""
    value = ctx.row(x).cast("double")
    middle = ctx.over_group(F.avg(value)) if center is True else F.lit(0.0 if center is False else float(center))
    if scale_ is True:
        spread = ctx.over_group(F.stddev_samp(value)) if center is not False else F.sqrt(ctx.over_group(F.sum(value * value)) / (ctx.over_group(F.count(value)) - 1))
    else:
        spread = F.lit(1.0 if scale_ is False else float(scale_))
    return Val((value - middle) / spread, "row", bool(ctx.frame.groups))


@function("window")
def duplicated(ctx, x, incomparables=None, from_last=False):
    """Whether the value occurred before (or occurs later, with ``from_last``)."""
    value = ctx.row(x)
    window = Window.partitionBy(*ctx.partition(), value).orderBy(*ctx.order_columns(reverse=from_last))
    out = F.row_number().over(window) > 1
    if incomparables:
        out = out & ~F.coalesce(value.isin(list(incomparables)), F.lit(False))
    return Val(out, "row", True)


@function("window")
def proportions(ctx, x, margin=1):
    """Share of each value in the sum of the group."""
    value = ctx.row(x).cast("double")
    return Val(value / ctx.over_group(F.sum(value)), "row", bool(ctx.frame.groups))


prop_table = proportions


@function("special", always=True)
def order_by(ctx, order, call):
    """Evaluate a window function in another row order."""
    before, ctx.explicit_order = ctx.explicit_order, list(order) if isinstance(order, (list, tuple)) else [order]
    try:
        return ctx.val(call)
    finally:
        ctx.explicit_order = before


def with_order(order, func, x, *args, **kwargs):
    """``func(x)`` in the order of another vector."""
    return order_by(order, func(x, *args, **kwargs))


