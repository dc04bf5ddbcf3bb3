"""Aggregate functions. Each has three forms: over a group, over a window, and over a vector
inside a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verbena.expr import Call, function
from verbena.frame import Context, Val, is_float, quoted
from verbena.options import get_option


def na(ctx: Context, x: Column) -> Column:
    """Missing: null, and NaN for floating point columns."""
    return x.isNull() | F.isnan(x) if is_float(ctx.dtype(x)) else x.isNull()


def usable(ctx: Context, x: Column) -> Column:
    """NaN as null where the option ``nan_is_na`` asks for it (scans are left as they are)."""
    return F.when(~F.isnan(x), x) if get_option("nan_is_na") and is_float(ctx.dtype(x)) else x


def guarded(ctx: Context, make, x: Column, na_rm: bool):
    """``make(A)`` unless a value is missing; A turns an aggregate into the form that is needed."""
    x = usable(ctx, x)

    def run(A):
        return make(A, x) if na_rm else F.when(A(F.bool_or(x.isNull())), F.lit(None)).otherwise(make(A, x))

    return run


def applied(ctx: Context, run, vector: bool = False) -> Val:
    """Run in summarise as an aggregate, elsewhere as a window over the group."""
    if ctx.mode == "agg" and ctx.depth == 0:
        return Val(run(lambda a: a), "aggarray" if vector else "agg")
    if not ctx.frame.groups:  # any mix of aggregates of all rows is one row
        return Val(ctx.over_group(run(lambda a: a)), "array" if vector else "row")
    window = ctx.group_window()
    return Val(run(lambda a: a.over(window)), "array" if vector else "row", True)


def vector_of(ctx: Context, x) -> Column | None:
    """The argument as a vector inside each row, under ``rowwise`` or where it is one."""
    if ctx.mode == "agg" and not ctx.frame.rowwise:
        return None
    v = ctx.val(x) if not isinstance(x, Column) else Val(x)
    if v.form == "array":
        return v.col
    return F.array(v.col) if ctx.frame.rowwise and ctx.mode == "row" else None


def known(a: Column) -> Column:
    return F.filter(a, lambda v: v.isNotNull())


def folded(fold, a: Column, na_rm: bool) -> Val:
    out = fold(known(a))
    return Val(out if na_rm else F.when(F.exists(a, lambda v: v.isNull()), F.lit(None)).otherwise(out))


def fold_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double"))


def fold_mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, fold_sum(a) / F.size(a))


def fold_var(a: Column, ddof: int = 1) -> Column:
    mean = fold_mean(a)
    return F.when(F.size(a) > ddof, F.aggregate(a, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean)) / (F.size(a) - ddof))


def fold_median(a: Column) -> Column:
    s, n = F.array_sort(a), F.size(a)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def define(name: str, make, fold):
    def lower(ctx, x, na_rm=False):
        a = vector_of(ctx, x)
        if a is not None:
            return folded(fold, a, na_rm)
        return applied(ctx, guarded(ctx, make, ctx.row(x), na_rm))

    lower.__name__, lower.__doc__ = name, f"{name} of the values of a group; missing if any value is, unless ``na_rm``."
    return function("agg", name)(lower)


mean = define("mean", lambda A, x: A(F.avg(x)), fold_mean)
median = define("median", lambda A, x: A(F.median(x)), fold_median)


@function("agg", "sum")
def sum_(ctx, x, na_rm=False):
    """Sum; of nothing, 0."""
    a = vector_of(ctx, x)
    if a is not None:
        return folded(fold_sum, a, na_rm)
    col = ctx.row(x)
    if isinstance(ctx.dtype(col), T.BooleanType):
        col = col.cast("bigint")
    return applied(ctx, guarded(ctx, lambda A, x: F.coalesce(A(F.sum(x)), F.lit(0)), col, na_rm))


prod = define("prod", lambda A, x: F.coalesce(A(F.product(x)), F.lit(1.0)), lambda a: F.aggregate(a, F.lit(1.0), lambda s, v: s * v.cast("double")))
min_ = define("min", lambda A, x: A(F.min(x)), F.array_min)
max_ = define("max", lambda A, x: A(F.max(x)), F.array_max)
sd = define("sd", lambda A, x: A(F.stddev_samp(x)), lambda a: F.sqrt(fold_var(a)))


@function("agg")
def var(ctx, x, na_rm=False, ddof=1):
    """Variance with ``ddof`` taken from the count."""
    a = vector_of(ctx, x)
    if a is not None:
        return folded(lambda a: fold_var(a, ddof), a, na_rm)
    if ddof == 1:
        return applied(ctx, guarded(ctx, lambda A, x: A(F.var_samp(x)), ctx.row(x), na_rm))
    return applied(ctx, guarded(ctx, lambda A, x: F.when(A(F.count(x)) > ddof, A(F.var_pop(x)) * A(F.count(x)) / (A(F.count(x)) - ddof)), ctx.row(x), na_rm))


@function("agg")
def cov(ctx, x, y=None, na_rm=False, ddof=1):
    """Covariance of two vectors."""
    a, b = ctx.row(x), ctx.row(y)
    pair = a.isNotNull() & b.isNotNull()

    def run(A):
        n = A(F.count(F.when(pair, 1)))
        out = A(F.covar_samp(a, b)) if ddof == 1 else F.when(n > ddof, A(F.covar_pop(a, b)) * n / (n - ddof))
        return out if na_rm else F.when(A(F.bool_or(~pair)), F.lit(None)).otherwise(out)

    return applied(ctx, run)


@function("agg")
def weighted_mean(ctx, x, w=None, na_rm=False):
    """Mean with weights; rows with a missing value or weight are left out if ``na_rm``."""
    if w is None:
        return Call("mean", (x,), {"na_rm": na_rm})
    a, b = ctx.row(x), ctx.row(w)
    a, b = a.cast("double"), b.cast("double")
    use = a.isNotNull()

    def run(A):
        total = A(F.sum(F.when(use, b)))
        out = F.when(total != 0, A(F.sum(a * b)) / total)
        return out if na_rm else F.when(A(F.bool_or(a.isNull() | b.isNull())), F.lit(None)).otherwise(out)

    return applied(ctx, run)


def quantile_of(a: Column, p: float, kind: int) -> Column:
    """Quantile of a sorted vector by one of the nine usual definitions."""
    n = F.size(a)
    if kind in (1, 2, 3):
        m = {1: 0.0, 2: 0.0, 3: -0.5}[kind]
        at = n * F.lit(p) + m
        j = F.floor(at + F.lit(1e-12))
        g = at - j
        exact = F.abs(g) < 1e-9
        gamma = F.when(exact, F.lit(0.0)).otherwise(1.0) if kind == 1 else F.when(exact, F.lit(0.5)).otherwise(1.0) if kind == 2 else F.when(exact & (j % 2 == 0), F.lit(0.0)).otherwise(1.0)
    else:
        alpha, beta = {4: (0, 1), 5: (0.5, 0.5), 6: (0, 0), 7: (1, 1), 8: (1 / 3, 1 / 3), 9: (3 / 8, 3 / 8)}[kind]
        at = F.lit(alpha + p * (1 - alpha - beta)) + n * F.lit(p)
        j = F.floor(at + F.lit(4e-15))
        gamma = F.greatest(at - j, F.lit(0.0))

    def pick(k):
        return F.get(a, (F.least(F.greatest(k, F.lit(1)), n) - 1).cast("int"))

    return F.when(n > 0, (1 - gamma) * pick(j) + gamma * pick(j + 1))


@function("agg")
def quantile(ctx, x, probs=(0.0, 0.25, 0.5, 0.75, 1.0), na_rm=False, names=True, type_=7, digits=7):
    """Quantiles; a single probability gives one value, several give a vector."""
    many = isinstance(probs, (list, tuple))
    values = [float(p) for p in probs] if many else [float(probs)]
    a = vector_of(ctx, x)
    if a is not None:
        s = F.array_sort(known(a))
        out = [quantile_of(s, p, type_) for p in values]
        return Val(F.array(*out), "array") if many else Val(out[0])
    col = ctx.row(x)
    if type_ == 7:
        make = lambda A, x: A(F.percentile(x, F.array(*map(F.lit, values)) if many else F.lit(values[0])))
    else:

        def make(A, x):
            s = F.array_sort(A(F.collect_list(x.cast("double"))))
            out = [quantile_of(s, p, type_) for p in values]
            return F.array(*out) if many else out[0]

    return applied(ctx, guarded(ctx, make, col, na_rm), vector=many)


@function("agg", "any")
def any_(ctx, x, na_rm=False):
    """Whether any value is true; unknown if none is and some are missing."""
    a = vector_of(ctx, x)
    if a is not None:
        return Val(F.exists(known(a) if na_rm else a, lambda v: v))
    col = ctx.row(x).cast("boolean")
    return applied(ctx, lambda A: F.coalesce(A(F.bool_or(col)), F.lit(False)) if na_rm else F.when(F.coalesce(A(F.bool_or(col)), F.lit(False)), F.lit(True)).when(A(F.bool_or(col.isNull())), F.lit(None)).otherwise(F.lit(False)))


@function("agg", "all")
def all_(ctx, x, na_rm=False):
    """Whether all values are true; unknown if none is false and some are missing."""
    a = vector_of(ctx, x)
    if a is not None:
        return Val(F.forall(known(a) if na_rm else a, lambda v: v))
    col = ctx.row(x).cast("boolean")
    return applied(ctx, lambda A: F.coalesce(A(F.bool_and(col)), F.lit(True)) if na_rm else F.when(~F.coalesce(A(F.bool_and(col)), F.lit(True)), F.lit(False)).when(A(F.bool_or(col.isNull())), F.lit(None)).otherwise(F.lit(True)))


@function("agg")
def any_na(ctx, x):
    """Whether any value is missing."""
    col = ctx.row(x)
    missing = na(ctx, col)
    return applied(ctx, lambda A: A(F.bool_or(missing)))


@function("agg")
def length(ctx, x):
    """Number of values."""
    a = vector_of(ctx, x)
    if a is not None:
        return Val(F.size(a).cast("bigint"))
    ctx.row(x)
    return applied(ctx, lambda A: A(F.count(F.lit(1))))


@function("agg", always=True)
def n(ctx, *ignored):
    """Rows of the group."""
    if ctx.frame.rowwise and ctx.mode == "row":
        return Val(F.lit(1).cast("bigint"))
    return applied(ctx, lambda A: A(F.count(F.lit(1))))


@function("agg")
def n_distinct(ctx, *xs, na_rm=True):
    """Number of distinct values, or of combinations; missing ones count unless ``na_rm``."""
    cols = [ctx.row(x) for x in xs]
    value = cols[0] if len(cols) == 1 else F.struct(*cols)
    gap = cols[0].isNull() if len(cols) == 1 else F.lit(False)

    def run(A):
        if (ctx.mode == "agg" and ctx.depth == 0) or not ctx.frame.groups:
            out = F.count_distinct(value)
        else:
            out = F.size(A(F.collect_set(value))).cast("bigint")
        return out if na_rm else out + A(F.max(gap.cast("bigint")))

    return applied(ctx, run)


@function("agg")
def approx_n_distinct(ctx, x, rsd=0.05):
    """Approximate number of distinct values (an extension)."""
    col = ctx.row(x)
    return applied(ctx, lambda A: A(F.approx_count_distinct(col, rsd)))


def order_key(ctx: Context, order_by, reverse: bool = False) -> Column:
    """One comparable column for the row order (or for ``order_by``)."""
    if order_by is not None:
        return ctx.row(order_by)
    ctx.frame = ctx.frame.fresh_row() if not any(d for _, d in ctx.frame.order) else ctx.frame.ordinal("__row")
    return quoted(ctx.frame.order[0][0])


def positional(name: str, pick):
    def lower(ctx, x, order_by=None, default=None):
        a = vector_of(ctx, x)
        if a is not None:
            return Val(F.coalesce(F.get(a, F.lit(0)) if name == "first" else F.element_at(a, -1), F.lit(default)))
        key = order_key(ctx, order_by)
        col = ctx.row(x)
        return applied(ctx, lambda A: F.when(A(F.count(F.lit(1))) == 0, ctx.col(default)).otherwise(pick(A, F.struct(col.alias("v")), key).getField("v")))

    lower.__name__, lower.__doc__ = name, f"The {name} value in row order or by ``order_by``."
    return function("agg", name)(lower)


first = positional("first", lambda A, x, k: A(F.min_by(x, k)))
last = positional("last", lambda A, x, k: A(F.max_by(x, k)))


@function("agg")
def nth(ctx, x, n, order_by=None, default=None):
    """The value at a 0-based position, from the end if negative."""
    a = vector_of(ctx, x)
    if a is None:
        key, col = order_key(ctx, order_by), ctx.row(x)
        at = n if n >= 0 else -n - 1

        def run(A):
            rows = F.array_sort(A(F.collect_list(F.struct(key.alias("k"), col.alias("v")))))
            rows = rows if n >= 0 else F.reverse(rows)
            return F.when(F.size(rows) > at, F.get(rows, F.lit(at)).getField("v")).otherwise(ctx.col(default))

        return applied(ctx, run)
    return Val(F.coalesce(F.get(a, F.lit(n)) if n >= 0 else F.try_element_at(a, F.lit(n)), F.lit(default)))


@function("agg")
def first2(ctx, _x, _y):
    """The y that comes first by x."""
    x, y = ctx.row(_x), ctx.row(_y)
    return applied(ctx, lambda A: A(F.min_by(y, x)))


@function("agg")
def last2(ctx, _x, _y):
    """The y that comes last by x."""
    x, y = ctx.row(_x), ctx.row(_y)
    return applied(ctx, lambda A: A(F.max_by(y, x)))


def which_extreme(name: str, pick):
    def lower(ctx, x):
        col = ctx.row(x)
        position = ctx.position()
        return applied(ctx, lambda A: pick(A, col, position))

    lower.__name__, lower.__doc__ = name, "0-based position of the first extreme value."
    return function("agg", name)(lower)


which_max = which_extreme("which_max", lambda A, x, p: A(F.max_by(p, F.when(x.isNotNull(), F.struct(x, -p)))))
which_min = which_extreme("which_min", lambda A, x, p: A(F.min_by(p, F.when(x.isNotNull(), F.struct(x, p)))))


@function("agg")
def which(ctx, x):
    """0-based positions of the true values."""
    col = ctx.row(x)
    position = ctx.position()
    return applied(ctx, lambda A: F.sort_array(A(F.collect_list(F.when(col, position)))), vector=True)


# ---------------------------------------------------------------- across the columns of a row
def row_function(name: str, fold):
    def lower(ctx, x, na_rm=False):
        v = ctx.val(x)
        if isinstance(ctx.dtype(v.col), T.StructType):
            fields = ctx.dtype(v.col).fieldNames()
            a = F.array(*[v.col.getField(k).cast("double") for k in fields])
        else:
            a = v.col
        return folded(fold, a, na_rm)

    lower.__name__, lower.__doc__ = name, "A statistic over the columns of each row."
    return function("row", name)(lower)


row_sums = row_function("row_sums", fold_sum)
row_means = row_function("row_means", fold_mean)
row_sds = row_function("row_sds", lambda a: F.sqrt(fold_var(a)))
row_medians = row_function("row_medians", fold_median)


def parallel(name: str, pick):
    def lower(ctx, *xs, na_rm=False):
        cols = [ctx.col(x) for x in xs]
        cols = cols if len(cols) > 1 else cols * 2
        if na_rm:
            return Val(pick(*cols), "row")
        gap = cols[0].isNull()
        for x in cols[1:]:
            gap = gap | x.isNull()
        return Val(F.when(~gap, pick(*cols)), "row")

    lower.__name__, lower.__doc__ = name, "Extreme of several vectors, element by element."
    return function("row", name)(lower)


pmin, pmax = parallel("pmin", F.least), parallel("pmax", F.greatest)


@function("row")
def max_col(ctx, x, ties_method="random", nested=True):
    """0-based index of the greatest column of each row."""
    v = ctx.val(x)
    a = F.array(*[v.col.getField(k).cast("double") for k in ctx.dtype(v.col).fieldNames()]) if isinstance(ctx.dtype(v.col), T.StructType) else v.col
    at = F.filter(F.transform(a, lambda e, i: F.when(e == F.array_max(a), i)), lambda i: i.isNotNull())
    pick = {"first": F.array_min(at), "last": F.array_max(at), "random": F.get(F.shuffle(at), F.lit(0))}[ties_method]
    return Val(pick.cast("bigint"))


__all__ = [k for k in dir() if not k.startswith("_") and type(globals()[k]).__name__ == "Function"]
