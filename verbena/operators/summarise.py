"""Aggregation verbs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verbena.expr import Call, Col, columns_of, verb
from verbena.frame import ROW, Context, Frame, Val, literal, quoted
from verbena.functions.factor import attach
from verbena.operators.mutate import computed, expanded


def grouped_keys(_data: Frame, args, kwargs) -> tuple[Frame, list[str]]:
    """The frame with computed keys, and their names."""
    from verbena.operators.select import resolve

    frame, keys = _data, []
    for name, x in expanded(_data, args, kwargs):
        if isinstance(x, (Col, str, int)) and not isinstance(x, bool):
            (old,) = resolve(frame, x)
            if name != old and isinstance(x, Col):
                frame = computed(frame, name, x)
                keys.append(name)
            else:
                keys.append(old)
        else:
            frame = computed(frame, name, x)
            keys.append(name)
    return frame, list(dict.fromkeys(keys))


def aggregate(frame: Frame, keys: list[str], columns: list[Column], order: bool = True) -> Frame:
    """One row for each group; where the frame has a row order, groups keep that of their first rows."""
    extra = []
    if order and frame.order and keys:
        if any(d for _, d in frame.order):
            frame = frame.ordinal(ROW) if ROW not in frame.df.columns else frame.with_(order=[(ROW, False)])
        extra = [F.min(F.struct(*[quoted(o) for o, _ in frame.order])).alias("__first")]
    grouped = frame.df.groupBy(*map(quoted, keys)) if keys else frame.df.groupBy()
    columns = columns + extra
    if not columns:
        return Frame(frame.df.select(*map(quoted, keys)).distinct())
    df = grouped.agg(*columns)
    return Frame(df, order=[("__first", False)] if extra else [], drop=frame.drop)


def empty_levels(frame: Frame, keys: list[str], fill: dict | None) -> Frame:
    """Groups for all levels of factor keys, the missing ones with null or filled columns."""
    from verbena.functions.factor import column_levels

    factors = [k for k in keys if column_levels(frame, k) is not None]
    if not factors:
        return frame
    grid = None
    for k in keys:
        if k in factors:
            own = frame.df.sparkSession.createDataFrame([(v,) for v in column_levels(frame, k)], [k])
        else:
            own = frame.df.select(quoted(k)).distinct()
        grid = own if grid is None else grid.crossJoin(own)
    rows = grid.join(frame.df, keys, "full_outer")
    columns = [attach(Val(quoted(c), levels=(column_levels(frame, c), False) if c in factors else None), c) if c not in (fill or {}) else F.coalesce(quoted(c), literal(fill[c])).alias(c) for c in frame.df.columns]
    return frame.with_(rows.select(*columns))


@verb
def summarise(_data, *args, _groups=None, **kwargs):
    """One row for each group. Results with several values become several rows. Later
    expressions may use earlier results; names that start with ``_`` are dropped."""
    frame = _data
    keys = list(frame.groups)
    ctx = Context(frame, "agg")
    if frame.rowwise:
        from verbena.operators.mutate import mutate

        out = mutate.run(frame, *args, **kwargs)
        made = [c for c, _ in expanded(frame, args, kwargs)]
        return out.keep(*map(quoted, [*keys, *[m for m in made if m not in keys]]), rowwise=False, groups=keys if _groups == "keep" else [])
    made: dict[str, Val] = {}
    for name, x in expanded(_data, args, kwargs):
        v = ctx.val(x)
        if v.form == "array" and not columns_of(x):  # a vector that is the same for all groups
            v = Val(v.col, "aggarray")
        if v.form in ("row", "array"):
            ctx.frame = ctx.frame.ordered()
            rows = F.collect_list(F.struct(*[quoted(o) for o, _ in ctx.frame.order], v.col.alias("v")))
            gathered = F.transform(F.array_sort(rows) if not any(d for _, d in ctx.frame.order) else rows, lambda r: r.getField("v"))
            v = Val(F.flatten(gathered) if v.form == "array" else gathered, "aggarray")
        made[name] = v
        ctx.results[name] = v.col
    out = aggregate(ctx.frame, keys, [attach(v, n) for n, v in made.items()])
    if not keys and not made:
        return Frame(_data.df.limit(0).select())
    vectors = [n for n, v in made.items() if v.form == "aggarray"]
    if vectors:
        zipped = F.arrays_zip(*map(quoted, vectors))
        rest = [c for c in out.df.columns if c not in vectors]
        spread = out.df.select(*map(quoted, rest), F.posexplode(zipped).alias("__at", "__z"))
        names = [*keys, *made]
        out = out.with_(spread.select(*[(F.col("__z").getField(n).alias(n) if n in vectors else quoted(n)) for n in names], *[quoted(c) for c in rest if c.startswith("__")], "__at"), order=[*out.order, ("__at", False)])
    if not frame.drop:
        out = empty_levels(out, keys, {n: 0 for n, x in expanded(_data, args, kwargs) if isinstance(x, Call) and x.name in ("n", "length")})
    temporary = [n for n in made if n.startswith("_")]
    out = out.with_(out.df.drop(*temporary)) if temporary else out
    if _groups == "rowwise":
        return out.with_(groups=keys, rowwise=True)
    kept = {"drop": [], "keep": keys}.get(_groups, keys[:-1])
    return out.with_(groups=kept, drop=frame.drop)


summarize = summarise


def counted(frame: Frame, keys: list[str], wt, sort: bool, name: str) -> Frame:
    ctx = Context(frame, "agg")
    total = F.count("*") if wt is None else F.coalesce(F.sum(ctx.row(wt)), F.lit(0))
    out = aggregate(ctx.frame, keys, [total.alias(name)])
    if not frame.drop:
        out = empty_levels(out, keys, {name: 0})
    if sort:
        from verbena.operators.rows import arrange

        out = arrange.run(out, Call("desc", (Col(name),)))
    return out


def free_name(name: str | None, keys: list[str]) -> str:
    name = name or "n"
    while name in keys:
        name += "n"
    return name


@verb
def count(_data, *args, wt=None, sort=False, name=None, _drop=None, **kwargs):
    """Rows (or the sum of weights) of each combination."""
    frame, keys = grouped_keys(_data, args, kwargs)
    frame = frame.with_(drop=frame.drop if _drop is None else _drop)
    keys = list(dict.fromkeys([*frame.groups, *keys]))
    out = counted(frame, keys, wt, sort, free_name(name, keys))
    return out.with_(groups=_data.groups, drop=_data.drop)


@verb
def tally(_data, wt=None, sort=False, name=None):
    """``count`` of the groups there are."""
    out = counted(_data, _data.groups, wt, sort, free_name(name, _data.groups))
    return out.with_(groups=_data.groups[:-1])


@verb
def add_count(_data, *args, wt=None, sort=False, name="n", **kwargs):
    """The count as a column."""
    frame, keys = grouped_keys(_data, args, kwargs)
    ctx = Context(frame.with_(groups=list(dict.fromkeys([*frame.groups, *keys]))))
    total = F.count(F.lit(1)) if wt is None else F.sum(ctx.row(wt))
    made = set(frame.columns) - set(_data.columns)
    total = ctx.over_group(total)
    out = ctx.frame.with_(ctx.frame.df.withColumn(name, total), groups=_data.groups)
    out = out.with_(out.df.drop(*[c for c in out.hidden if c.startswith("__t")]))
    out = out.with_(out.df.drop(*[m for m in made if m not in kwargs]))
    if sort:
        from verbena.operators.rows import arrange

        out = arrange.run(out, Call("desc", (Col(name),)))
    return out


@verb
def add_tally(_data, wt=None, sort=False, name="n"):
    """The size of the group as a column."""
    return add_count.run(_data, wt=wt, sort=sort, name=name)


# ---------------------------------------------------------------- columns of a frame
def column_statistic(name: str, fn: str):
    def run(x, na_rm=False):
        from verbena.functions.aggregate import guarded

        ctx = Context(x.with_(groups=[]), "agg")
        make = {"sum": lambda A, c: F.coalesce(F.sum(c), F.lit(0)), "mean": lambda A, c: F.avg(c), "sd": lambda A, c: F.stddev_samp(c), "median": lambda A, c: F.median(c)}[fn]
        return Frame(x.df.agg(*[guarded(ctx, make, quoted(c), na_rm)(lambda a: a).alias(c) for c in x.columns]))

    run.__name__, run.__doc__ = name, f"The {fn} of every column, in one row."
    return verb(run)


col_sums, col_means = column_statistic("col_sums", "sum"), column_statistic("col_means", "mean")
col_sds, col_medians = column_statistic("col_sds", "sd"), column_statistic("col_medians", "median")


@verb
def cov_matrix(x, ddof=1):
    """Covariances of all pairs of columns, in one pass."""
    names = x.columns
    pairs = [(a, b) for a in names for b in names]
    fn = F.covar_samp if ddof == 1 else F.covar_pop
    row = x.df.agg(*[fn(quoted(a), quoted(b)).alias(f"{a}\0{b}") for a, b in pairs]).first()
    from verbena.frame import frame_of

    return frame_of({"name": names, **{b: [row[f"{a}\0{b}"] for a in names] for b in names}})


@verb
def table(x, *more, exclude=None, use_na="no", dnn=None, deparse_level=1):
    """Cross-tabulation of one column, two, or more (then in long form)."""
    from verbena.operators.select import resolve

    if not more:
        names = x.columns
    elif not any(isinstance(m, Frame) for m in more):
        names = [n for m in more for n in resolve(x, m)]
    else:
        raise TypeError("columns of one frame are tabulated")
    df = x.df.select(*map(quoted, names))
    if use_na == "no":
        df = df.dropna(subset=names)
    for v in exclude or ():
        for n in names:
            df = df.where(quoted(n).cast("string") != F.lit(str(v)))
    if len(names) == 2:
        a, b = names
        values = sorted(r[0] for r in df.select(quoted(b)).distinct().collect() if r[0] is not None)
        return Frame(df.groupBy(quoted(a)).pivot(b, values).count().na.fill(0))
    out = df.groupBy(*map(quoted, names)).count().withColumnRenamed("count", "n")
    return Frame(out.withColumnsRenamed(dict(zip(names, dnn, strict=True))) if dnn else out)


@verb(plain=1)
def tabulate(bin, nbins=None):
    """Counts of the integers 1 to ``nbins``."""
    if isinstance(bin, Frame):
        (name,) = bin.columns[:1]
        top = nbins or bin.df.agg(F.max(quoted(name))).first()[0]
        counts = {r[0]: r[1] for r in bin.df.where(quoted(name).between(1, top)).groupBy(quoted(name)).count().collect()}
    else:
        values = [v for v in bin if v is not None]
        top = nbins or max(values, default=0)
        counts = {v: values.count(v) for v in set(values)}
    return [counts.get(i, 0) for i in range(1, top + 1)]


@verb(plain=1)
def fct_count(_f, sort=False, prop=False):
    """Rows of each level (empty ones too): a frame of f, n and, if asked for, the share p."""
    from verbena.frame import frame_of
    from verbena.functions.factor import column_levels, to_factor

    if isinstance(_f, Frame):
        (name,) = _f.columns[:1]
        counts = {r[0]: r[1] for r in _f.df.groupBy(quoted(name)).count().collect()}
        levels = column_levels(_f, name) or sorted(k for k in counts if k is not None)
    else:
        x = to_factor(_f)
        levels = x.levels
        counts = {k: list(x).count(k) for k in {*x, *levels}}
    rows = [(k, counts.get(k, 0)) for k in levels] + ([(None, counts[None])] if counts.get(None) else [])
    if sort:
        rows.sort(key=lambda r: -r[1])
    total = sum(r[1] for r in rows) or 1
    out = {"f": [r[0] for r in rows], "n": [r[1] for r in rows]}
    return frame_of(out | ({"p": [r[1] / total for r in rows]} if prop else {}))
