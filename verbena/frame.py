"""Frames: a Spark DataFrame with grouping, row order and row names, and the lowering of
expressions to Spark columns.

One function has up to three forms: an aggregate in ``summarise``, a window over the group in
``mutate`` and ``filter_``, and a fold over an array under ``rowwise``.
"""

from __future__ import annotations

import datetime
import math
import re
from collections import Counter
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verbena.expr import FUNCTIONS, Attr, Call, Col, Expr, Item, Method, Op, Range, RangeList, Symbol, has_expr

#: Hidden columns start with this.
HIDDEN = "__"
ROW = "__row"
RESERVED_ROWNAMES = "__rowname"
#: Rows whose keys are looked at to cut an order into ranges; a frame with fewer is one range.
SAMPLE = 2_048
#: Bounds that are compared at once: first every so many, then those between two of them.
BOUNDS = 16


class ColumnNotExistingError(KeyError):
    """A column that the frame does not have."""


class OrderRequiredError(ValueError):
    """An operation that depends on row order, on a frame without one."""


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


class Frame:
    """An immutable frame. ``order``: (column, descending) pairs that give the row order."""

    def __init__(self, df: DataFrame, groups=(), rowwise: bool = False, order=(), drop: bool = True, known=None, base=None, parts=None):
        self.df, self.groups, self.rowwise, self.order, self.drop = df, list(groups), rowwise, list(order), drop
        #: What a verb has computed on the way: a key -> names of hidden columns (or None).
        self.known: dict[str, tuple[str, ...] | None] = dict(known or {})
        #: A plan of the same rows from which ``df`` only differs by added columns: sums over all rows
        #: are taken from it, so that the columns added before are not computed again for them.
        self.base: DataFrame | None = base
        #: The expressions of range numbers, by the same keys.
        self.parts: dict[str, Column] = dict(parts or {})

    # ------------------------------------------------------------ structure
    @property
    def columns(self) -> list[str]:
        return [x for x in self.df.columns if not x.startswith(HIDDEN)]

    @property
    def hidden(self) -> list[str]:
        return [x for x in self.df.columns if x.startswith(HIDDEN)]

    @property
    def schema(self) -> T.StructType:
        return T.StructType([x for x in self.df.schema if not x.name.startswith(HIDDEN)])

    def dtype(self, name: str) -> T.DataType:
        return self.df.schema[name].dataType

    def with_(self, df: DataFrame | None = None, **changes) -> Frame:
        state = {"groups": self.groups, "rowwise": self.rowwise, "order": self.order, "drop": self.drop} | ({"known": self.known, "base": self.base, "parts": self.parts} if df is None else {}) | changes
        df = self.df if df is None else df
        have = set(df.columns)
        state["known"] = {k: c for k, c in state.get("known", {}).items() if c is None or have.issuperset(c)}
        state["groups"] = [g for g in state["groups"] if g in have]
        if any(o not in have for o, _ in state["order"]):
            state["order"] = []
        return Frame(df, **state)

    def keep(self, *columns: Column | str, **changes) -> Frame:
        """Visible columns replaced by these; hidden ones stay."""
        return self.with_(self.df.select(*columns, *[quoted(h) for h in self.hidden]), **changes)

    def ordered(self) -> Frame:
        """The frame with a row order: its own, or the order in which its source is read. Behind a
        shuffle there is none that would be the same in two branches of a plan; then rows are
        ordered by their content."""
        if self.order:
            return self
        if is_scan(self.df):
            return self.with_(self.df.withColumn(ROW, F.monotonically_increasing_id()), order=[(ROW, False)])
        keys = [quoted(x.name) for x in self.df.schema if not has_map(x.dataType)] or [F.lit(0)]
        return self.with_(self.df.withColumn(CONTENT, F.xxhash64(*keys)), order=[(CONTENT, False)])

    def added(self, df: DataFrame, **known) -> Frame:
        """The same rows with more columns."""
        return self.with_(df, known=self.known | known, base=self.df if self.base is None else self.base, parts=self.parts)

    def source(self, *columns: Column) -> DataFrame:
        """The plan from which these columns can be computed with the least of what was added."""
        if self.base is None or self.base is self.df:
            return self.df
        read = self.df.select(*columns)._jdf.queryExecution().analyzed().references().mkString("\n")
        names = {re.sub(r"#\d+L?$", "", x) for x in read.split("\n") if x}
        return self.base if names <= set(self.base.columns) else self.df

    def sort_columns(self, reverse: bool = False) -> list[Column]:
        return [(quoted(o).desc_nulls_last() if d != reverse else quoted(o).asc_nulls_last()) for o, d in self.order]

    def fresh_row(self) -> Frame:
        """The order as one hidden column (a struct), so that it survives joins and groups."""
        own = self.ordered()
        if own.order == [(ROW, False)]:
            return own
        if any(d for _, d in own.order):
            raise OrderRequiredError("a descending order has no key column; use ordinal()")
        return own.with_(own.df.withColumn(ROW, F.struct(*[quoted(o) for o, _ in own.order])), order=[(ROW, False)])

    def ordinal(self, name: str) -> Frame:
        """Add the 0-based position of every row: positions inside ranges of the order plus the
        rows of the ranges before, so no task holds all rows."""
        own = self.ordered()
        keys = [(quoted(o), d) for o, d in own.order]
        part = range_number(own.df, keys)
        if not self.order and own.order == [(ROW, False)]:  # just numbered, without gaps
            place = quoted(ROW).bitwiseAND(F.lit((1 << 33) - 1))
            counts = own.source(part).groupBy(part.alias("__pid")).agg(F.count("*").alias("__n"))
            starts = counts.select("__pid", (F.sum("__n").over(Window.orderBy("__pid")) - F.col("__n")).alias("__start"))
            parts = own.df.withColumn("__pid", part).join(F.broadcast(starts), "__pid")
            out = parts.select(*[quoted(c) for c in own.df.columns if c != name], (F.col("__start") + place).alias(name))
            return own.with_(out, order=[(name, False)] if name.startswith(HIDDEN) else own.order)
        inside = Window.partitionBy() if part is None else Window.partitionBy("__pid")
        parts = own.df if part is None else own.df.withColumn("__pid", part)
        parts = parts.withColumn(name, (F.row_number().over(inside.orderBy(*own.sort_columns())) - 1).cast("bigint"))
        if part is not None:
            # counted from the same deterministic ranges, in a branch that reads the keys alone
            counts = own.source(part).select(part.alias("__pid")).groupBy("__pid").agg(F.count("*").alias("__n"))
            starts = counts.select("__pid", (F.sum("__n").over(Window.orderBy("__pid")) - F.col("__n")).alias("__start"))
            parts = parts.join(F.broadcast(starts), "__pid").withColumn(name, F.col("__start") + quoted(name))
        columns = [c for c in own.df.columns if c != name]
        return own.with_(parts.select(*map(quoted, columns), quoted(name)), order=[(name, False)] if name.startswith(HIDDEN) else own.order)

    # ------------------------------------------------------------ actions
    def visible(self) -> DataFrame:
        """The plain DataFrame in row order."""
        df = self.df.orderBy(*self.sort_columns()) if self.order else self.df
        return df.select(*[quoted(x) for x in self.columns])

    def collect(self) -> list[tuple]:
        return [tuple(r) for r in self.visible().collect()]

    def to_pandas(self) -> pd.DataFrame:
        return self.visible().toPandas()

    def to_dict(self) -> dict[str, list]:
        rows = self.collect()
        return {x: [r[i] for r in rows] for i, x in enumerate(self.columns)}

    def __repr__(self):
        groups = f", groups={self.groups}" if self.groups else ""
        return f"<Frame [{', '.join(f'{x.name}: {x.dataType.simpleString()}' for x in self.schema)}]{groups}{', rowwise' if self.rowwise else ''}>"

    def __getitem__(self, name):
        from verbena.operators.select import pull

        return pull(self, name)


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


# ---------------------------------------------------------------- ranges of an order
#: Hidden order by content.
CONTENT = "__content"


def has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return has_map(kind.elementType)
    return isinstance(kind, T.MapType) or (isinstance(kind, T.StructType) and any(has_map(x.dataType) for x in kind))


def is_scan(df: DataFrame) -> bool:
    """Whether a plan only reads, filters and projects a source: then its partitions and the rows
    in them are the same whenever it runs."""
    names = re.findall(r"^[ :|+-]*'?(\w+)", df._jdf.queryExecution().analyzed().toString(), re.MULTILINE)
    return set(names) <= {"Project", "Filter", "Relation", "LocalRelation", "LogicalRDD", "Range", "SubqueryAlias", "View", "StreamingRelation", "StreamingRelationV2", "EventTimeWatermark"}


def stands_before(a: Column, b: Column, down: bool) -> Column:
    """Whether a key comes before another; missing ones come last either way."""
    return F.coalesce(a.isNotNull() & (b.isNull() | ((a > b) if down else (a < b))), F.lit(False))


def range_number(df: DataFrame, keys: list[tuple[Column, bool]]) -> Column | None:
    """The number of the range of an order in which a row lies, as an expression of its keys alone,
    so that two branches of a plan agree on it; None where the frame is small, or a stream. The
    bounds come from a sample of the keys. Rows with equal keys lie in one range."""
    if df.isStreaming:
        return None
    names = [f"k{i}" for i in range(len(keys))]
    if [str(k) for k, _ in keys] == [str(quoted(ROW))] and f"monotonically_increasing_id() AS {ROW}#" in df._jdf.queryExecution().analyzed().toString():
        return F.shiftright(quoted(ROW), 33)  # the partition that was read
    seen = df.select(*[k.alias(n) for (k, _), n in zip(keys, names, strict=True)])
    if any(isinstance(x.dataType, (T.StructType, T.ArrayType, T.MapType)) for x in seen.schema):
        return None
    order = [F.col(n).desc_nulls_last() if d else F.col(n).asc_nulls_last() for (_, d), n in zip(keys, names, strict=True)]
    sample = seen.orderBy(F.rand(1)).limit(SAMPLE).orderBy(*order).collect()
    parts = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), len(sample) // 8)
    if len(sample) < SAMPLE or parts < 2:
        return None
    picks = list(dict.fromkeys(sample[len(sample) * i // parts] for i in range(1, parts)))
    bounds = F.array(*[F.struct(*[F.lit(v).cast(x.dataType).alias(x.name) for v, x in zip(row, seen.schema, strict=True)]) for row in picks])

    def reached(b: Column) -> Column:
        """Whether a row's key is not before a bound."""
        out, same = F.lit(False), F.lit(True)
        for (k, d), n in zip(keys, names, strict=True):
            out = out | (same & stands_before(k, b.getField(n), d))
            same = same & k.eqNullSafe(b.getField(n))
        return ~out

    coarse = F.array(*[F.get(bounds, F.lit(i)) for i in range(BOUNDS - 1, len(picks), BOUNDS)]) if len(picks) >= BOUNDS else None
    if coarse is None:
        return F.size(F.filter(bounds, reached)).cast("bigint")
    whole = F.size(F.filter(coarse, reached)) * BOUNDS
    return (whole + F.size(F.filter(F.slice(bounds, whole + 1, F.lit(BOUNDS)), reached))).cast("bigint")


def large_groups(df: DataFrame, groups: list[Column]) -> bool:
    """Whether, by a sample of rows, some group has more rows than a task of a shuffle gets anyway (or
    one of 32 of them); never in a small frame."""
    if df.isStreaming:
        return False
    sample = df.select(*[g.alias(f"g{i}") for i, g in enumerate(groups)]).orderBy(F.rand(1)).limit(SAMPLE).collect()
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return len(sample) == SAMPLE and max(Counter(map(repr, sample)).values()) * max(parts, 32) > SAMPLE


def group_positions(frame: Frame, keys: list[tuple[Column, bool]], name: str) -> DataFrame | None:
    """The frame with the 0-based position of every row in its group, by ranges of the order of which
    each holds a part of a group; None where windows over whole groups do."""
    groups = [quoted(g) for g in frame.groups]
    if not large_groups(frame.source(*groups), groups):
        return None
    part = range_number(frame.source(*[k for k, _ in keys]), keys)
    if part is None:
        return None
    if str(part) == str(F.shiftright(quoted(ROW), 33)):  # as read: in pieces of about a million rows
        part = F.shiftright(quoted(ROW), 20)
    of = [f"__of{i}" for i in range(len(groups))]
    inside = Window.partitionBy("__pid", *groups).orderBy(*[k.desc_nulls_last() if d else k.asc_nulls_last() for k, d in keys])
    rows = frame.df.withColumn("__pid", part).withColumn("__place", (F.row_number().over(inside) - 1).cast("bigint"))
    counts = frame.source(part, *groups).select(part.alias("__range"), *[g.alias(n) for g, n in zip(groups, of, strict=True)]).groupBy("__range", *of).agg(F.count("*").alias("__n"))
    starts = counts.select("__range", *of, (F.sum("__n").over(Window.partitionBy(*of).orderBy("__range")) - F.col("__n")).alias("__start"))
    same = F.col("__pid") == F.col("__range")
    for g, n in zip(groups, of, strict=True):
        same = same & g.eqNullSafe(F.col(n))
    return rows.join(starts, same).select(*[quoted(c) for c in frame.df.columns if c != name], (F.col("__start") + F.col("__place")).alias(name))


def is_table(x: Any) -> bool:
    return isinstance(x, (Frame, DataFrame, pd.DataFrame))


def as_frame(x: Any) -> Frame:
    if isinstance(x, Frame):
        return x
    if isinstance(x, pd.DataFrame):
        return frame_of({str(k): x[k].tolist() for k in x.columns})
    return Frame(x)


# ---------------------------------------------------------------- literals
def missing(x: Any) -> bool:
    return x is None or x is pd.NaT or (isinstance(x, (float, np.floating)) and math.isnan(x))


def clean(x: Any) -> Any:
    """A Python value as Spark takes it; every missing value is None."""
    if isinstance(x, (list, tuple, np.ndarray, range)):
        return [clean(v) for v in x]
    if isinstance(x, dict):
        return {k: clean(v) for k, v in x.items()}
    if missing(x):
        return None
    if isinstance(x, np.generic):
        return x.item()
    if isinstance(x, pd.Timestamp):
        return x.to_pydatetime()
    return x


def type_of(values: list) -> T.DataType:
    """The narrowest type that holds all values; integers are 64 bit."""
    seen = [v for v in values if v is not None]
    if not seen:
        return T.DoubleType()
    kinds = {type(v) for v in seen}
    if kinds <= {bool}:
        return T.BooleanType()
    if kinds <= {int, bool}:
        return T.LongType()
    if kinds <= {int, float, bool}:
        return T.DoubleType()
    if kinds <= {str}:
        return T.StringType()
    if kinds <= {datetime.datetime}:
        return T.TimestampNTZType()
    if kinds <= {datetime.date}:
        return T.DateType()
    if kinds <= {complex, int, float}:
        return T.StructType([T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())])
    if kinds <= {list}:
        return T.ArrayType(type_of([v for x in seen for v in x]))
    if kinds <= {dict}:
        keys = list(dict.fromkeys(k for x in seen for k in x))
        return T.StructType([T.StructField(k, type_of([x.get(k) for x in seen])) for k in keys])
    return T.StringType()


def fit_value(v: Any, kind: T.DataType) -> Any:
    if v is None:
        return None
    if isinstance(kind, T.DoubleType):
        return float(v)
    if isinstance(kind, T.LongType):
        return int(v)
    if isinstance(kind, T.StringType):
        return v if isinstance(v, str) else str(v)
    if isinstance(kind, T.ArrayType):
        return [fit_value(x, kind.elementType) for x in v]
    if isinstance(kind, T.StructType) and isinstance(v, dict):
        return tuple(fit_value(v.get(x.name), x.dataType) for x in kind)
    if isinstance(kind, T.StructType):
        return (complex(v).real, complex(v).imag)
    return v


def frame_of(columns: dict[str, Any], kinds: dict[str, T.DataType] | None = None) -> Frame:
    """A frame of driver-side vectors of one length, in their order."""
    columns = {k: [clean(x) for x in v] for k, v in columns.items()}
    fields = [T.StructField(k, (kinds or {}).get(k) or type_of(v)) for k, v in columns.items()]
    n = max(map(len, columns.values()), default=0)
    rows = [(*[fit_value(columns[x.name][i], x.dataType) for x in fields], i) for i in range(n)]
    schema = T.StructType([*fields, T.StructField(ROW, T.LongType())])
    return Frame(session().createDataFrame(rows, schema), order=[(ROW, False)])


def literal(x: Any) -> Column:
    x = clean(x)
    if isinstance(x, list):
        kind = type_of(x)
        return F.array(*[literal(fit_value(v, kind)) for v in x]) if x else F.array().cast("array<double>")
    if isinstance(x, complex):
        return F.struct(F.lit(x.real).alias("re"), F.lit(x.imag).alias("im"))
    if isinstance(x, dict):
        return F.struct(*[literal(v).alias(k) for k, v in x.items()])
    if isinstance(x, int) and not isinstance(x, bool):
        return F.lit(x).cast("bigint")
    return F.lit(x)


# ---------------------------------------------------------------- lowering
class Val:
    """A lowered expression. ``form``: const, row, agg or array (a vector in each row);
    ``window``: it holds a window function."""

    __slots__ = ("col", "form", "levels", "window")

    def __init__(self, col: Column, form: str = "row", window: bool = False, levels=None):
        self.col, self.form, self.window, self.levels = col, form, window, levels


class Context:
    """Lowers expressions against a frame. ``mode``: ``row`` (mutate, filter: aggregates become
    windows) or ``agg`` (summarise)."""

    def __init__(self, frame: Frame, mode: str = "row", results: dict[str, Column] | None = None):
        self.frame, self.mode = frame, mode
        self.results = results or {}
        self.depth = 0
        self.column_name: str | None = None
        self.explicit_order: Any = None

    # frame access
    @property
    def df(self) -> DataFrame:
        return self.frame.df

    def has(self, name: str) -> bool:
        return name in self.frame.df.columns

    def partition(self) -> list[Column]:
        return [quoted(g) for g in self.frame.groups]

    def group_window(self):
        return Window.partitionBy(*(self.partition() or [F.lit(0)])) if self.frame.groups else Window.partitionBy()

    def no_stream(self) -> None:
        if self.df.isStreaming:
            raise OrderRequiredError("ranking, offset and cumulative functions need all rows in order; a stream has none")

    def order_keys(self) -> list[tuple[Column, bool]]:
        """The keys of the row order (or of the one asked for) and whether they descend."""
        self.no_stream()
        if self.explicit_order is not None:
            return [key_of(self, k) for k in self.explicit_order]
        self.frame = self.frame.ordered()
        return [(quoted(o), d) for o, d in self.frame.order]

    def order_columns(self, reverse: bool = False) -> list[Column]:
        return [k.desc_nulls_last() if d != reverse else k.asc_nulls_last() for k, d in self.order_keys()]

    def order_window(self, reverse: bool = False):
        return Window.partitionBy(*self.partition()).orderBy(*self.order_columns(reverse))

    def running(self):
        return self.order_window().rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def range_column(self) -> tuple[Column, Column] | None:
        """Without groups: (column, expression) of the number of the range of the order in which each
        row lies; None with groups, or where one range is enough."""
        if self.frame.groups or self.frame.rowwise:
            return None
        keys = self.order_keys()
        mark = f"range of {[(str(k), d) for k, d in keys]}"
        if mark not in self.frame.known:
            part = range_number(self.frame.source(*[k for k, _ in keys]), keys)
            name = None if part is None else (self.fresh(),)
            df = self.df if part is None else self.df.withColumn(name[0], part)
            self.frame = self.frame.added(df, **{mark: name})
            if part is not None:
                self.frame.parts[mark] = part
        if self.frame.known[mark] is None:
            return None
        column = quoted(self.frame.known[mark][0])
        return column, self.frame.parts.get(mark, column)

    def inside(self, part: Column, back: bool = False):
        """The window of a range, in order."""
        return Window.partitionBy(part).orderBy(*self.order_columns(back))

    def branch(self, part: Column, value: Column, back: bool = False) -> DataFrame:
        """(__pid, __v, __e) of every row: range, value, and place from the end of the range (from
        its start, with ``back``)."""
        keys = self.order_keys()
        own = self.frame.source(part, value, *[k for k, _ in keys])
        rows = own.select(part.alias("__pid"), value.alias("__v"), *[k.alias(f"__o{i}") for i, (k, _) in enumerate(keys)])
        order = [F.col(f"__o{i}").desc_nulls_last() if d == back else F.col(f"__o{i}").asc_nulls_last() for i, (_, d) in enumerate(keys)]
        if not back:
            order = [F.col(f"__o{i}").asc_nulls_first() if d else F.col(f"__o{i}").desc_nulls_first() for i, (_, d) in enumerate(keys)]
        return rows.withColumn("__e", F.row_number().over(Window.partitionBy("__pid").orderBy(*order)))

    def carried(self, column: Column, each: DataFrame, merge, back: bool = False) -> Column:
        """What all ranges before each row's own (behind it, with ``back``) give together; ``each``
        has (__pid, __x) of every range, ``merge(x, over)`` makes one of them. One row for each range
        is broadcast."""
        name = self.fresh()
        ahead = Window.orderBy(F.col("__pid").desc() if back else F.col("__pid").asc()).rowsBetween(Window.unboundedPreceding, -1)
        sums = each.select(F.col("__pid").alias("__of"), merge(F.col("__x"), lambda x: x.over(ahead)).alias(name))
        self.frame = self.frame.added(self.df.join(F.broadcast(sums), column == F.col("__of"), "left").drop("__of"))
        return quoted(name)

    def running_value(self, aggregate, value: Column, merge) -> Column:
        """An aggregate of all rows up to each one; over a whole table by ranges."""
        found = self.range_column()
        if found is None:
            return aggregate(value).over(self.running())
        column, part = found
        local = self.hoist(aggregate(value).over(self.inside(column).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        each = self.frame.source(part, value).select(part.alias("__pid"), value.alias("__v")).groupBy("__pid").agg(aggregate(F.col("__v")).alias("__x"))
        return merge(self.carried(column, each, lambda x, over: over(aggregate(x))), local)

    def nearest(self, value: Column, back: bool = False) -> Column:
        """The last value that is not missing up to each row (the next one, with ``back``)."""

        def inside(window, *parts: Column) -> Column:
            if not back:
                return F.last(value, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))
            # rows with as many values before them end with the next one; a frame up to the end of
            # the window would be read again for every row
            before = self.hoist(F.count(value).over(window.rowsBetween(Window.unboundedPreceding, -1)))
            return F.first(value, ignorenulls=True).over(Window.partitionBy(*parts, before))

        found = self.range_column()
        if found is None:
            return inside(self.order_window(), *self.partition())
        column, part = found
        local = self.hoist(inside(self.inside(column), column))
        each = self.branch(part, value, back).where("__v is not null").groupBy("__pid").agg(F.min_by("__v", "__e").alias("__x"))
        ranges = self.frame.source(part).select(part.alias("__pid")).distinct()
        far = self.carried(column, ranges.join(each, "__pid", "left"), lambda x, over: over(F.last(x, ignorenulls=True)), back)
        return F.coalesce(local, far)

    def shifted(self, value: Column, n: int, back: bool) -> tuple[Column, Column]:
        """(the value n rows back or ahead, whether there is such a row)."""
        move = F.lag if back else F.lead
        found = self.range_column()
        if found is None:
            window = self.order_window()
            return move(value, n).over(window), move(F.lit(1), n).over(window).isNotNull()
        column, part = found
        place = self.hoist(F.row_number().over(self.inside(column)))
        rows = self.hoist(F.count(F.lit(1)).over(Window.partitionBy(column)))
        near = self.hoist(move(value, n).over(self.inside(column)))
        # the n rows at the end of each range that is looked at, the nearest one first
        cut = F.sort_array(F.collect_list(F.struct("__e", "__v")))
        each = self.branch(part, value, not back).where(F.col("__e") <= n).groupBy("__pid").agg(F.transform(cut, lambda x: x.getField("__v")).alias("__x"))
        ends = self.carried(column, each, lambda x, over: F.flatten(F.reverse(over(F.collect_list(x)))), not back)
        at = n - (place if back else rows - place + 1)
        inside = at < 0
        return F.when(inside, near).otherwise(F.get(ends, at.cast("int"))), inside | (at < F.coalesce(F.size(ends), F.lit(0)))

    def fresh(self) -> str:
        """A name for a hidden column."""
        taken = [int(x[3:]) for x in self.frame.df.columns if x.startswith("__t") and x[3:].isdigit()]
        return f"__t{max(taken, default=-1) + 1}"

    def hoist(self, col: Column) -> Column:
        """Compute a column before the others: window functions do not nest."""
        name = self.fresh()
        self.frame = self.frame.added(self.frame.df.withColumn(name, col))
        return quoted(name)

    def over_group(self, col: Column) -> Column:
        """An aggregate of the group beside each row: a window where there are groups; of all
        rows, one aggregate that is broadcast back, so that no task sees all of them."""
        if self.frame.groups:
            return col.over(self.group_window())
        name = self.fresh()
        one = self.frame.source(col).agg(col.alias(name))
        self.frame = self.frame.added(self.frame.df.crossJoin(F.broadcast(one)))
        return quoted(name)

    def position(self) -> Column:
        """The 0-based position of each row in its group."""
        if self.frame.groups:
            keys = self.order_keys()
            name = self.fresh()
            made = group_positions(self.frame, keys, name)
            if made is None:
                return self.hoist((F.row_number().over(self.order_window()) - 1).cast("bigint"))
            self.frame = self.frame.added(made)
            return quoted(name)
        if self.explicit_order is not None:
            one = F.lit(1).cast("bigint")
            return self.hoist(self.running_value(F.sum, one, lambda a, b: F.coalesce(a, F.lit(0)) + b) - 1)
        self.frame = self.frame.ordered()
        order = self.frame.order
        name = self.fresh()
        self.frame = self.frame.added(self.frame.ordinal(name).df).with_(order=order)
        return quoted(name)

    def dtype(self, col: Column) -> T.DataType:
        return self.df.select(col.alias("x")).schema[0].dataType

    # values
    def val(self, x: Any) -> Val:
        if isinstance(x, Val):
            return x
        if isinstance(x, Column):
            return Val(x)
        if isinstance(x, Col):
            return self.column(x.name)
        if isinstance(x, Symbol):
            return Val(F.struct(*[quoted(n) for n in self.frame.columns]))
        if isinstance(x, RangeList):
            return Val(literal(list(x)), "array")
        if isinstance(x, Range):
            return Val(literal(x.values()), "array")
        if isinstance(x, Op):
            return lower_op(self, x)
        if isinstance(x, Call):
            return self.call(FUNCTIONS[x.name], x.args, x.kwargs)
        if isinstance(x, Method):
            return lower_method(self, x)
        if isinstance(x, Attr):
            return Val(self.val(x.parent).col.getField(x.attr), self.val(x.parent).form)
        if isinstance(x, Item):
            return lower_item(self, x)
        if isinstance(x, Expr):
            raise TypeError(f"{type(x).__name__} cannot be used here")
        if isinstance(x, (list, tuple, np.ndarray, range, pd.Series)):
            x = list(x)
            if has_expr(x):
                return Val(F.array(*[self.col(v) for v in x]), "array")
            return Val(literal(x), "array")
        return Val(literal(x), "const")

    def column(self, name: str | int) -> Val:
        if isinstance(name, int):
            name = self.frame.columns[name]
        if name in self.results and (self.depth == 0 or not self.has(name)):
            return Val(self.results[name], "agg")
        if not self.has(name):
            raise ColumnNotExistingError(f"column {name!r} does not exist")
        field = self.df.schema[name]
        levels = (field.metadata or {}).get("levels")
        key = self.mode == "agg" and self.depth == 0 and name in self.frame.groups
        return Val(quoted(name), "agg" if key else ("array" if self.frame.rowwise and isinstance(field.dataType, T.ArrayType) else "row"), levels=(levels, (field.metadata or {}).get("ordered", False)) if levels is not None else None)

    def col(self, x: Any) -> Column:
        return self.val(x).col

    def row(self, x: Any) -> Column:
        """An argument of an aggregate or window function: a plain row value."""
        self.depth += 1
        mode, self.mode = self.mode, "row"
        try:
            v = self.val(x)
            return self.hoist(v.col) if v.window else v.col
        finally:
            self.mode = mode
            self.depth -= 1

    def call(self, fn, args, kwargs) -> Val:
        out = fn.lower(self, *args, **kwargs)
        if isinstance(out, Val):
            return out
        if isinstance(out, Expr):
            return self.val(out)
        if fn.kind == "window":
            return Val(out, "row", True)
        if fn.kind == "row":
            return Val(out, combined([self.val(a) for a in args if isinstance(a, Expr)]), any(self.val(a).window for a in args if isinstance(a, Expr)))
        return Val(out)


def combined(values: list[Val]) -> str:
    forms = {v.form for v in values}
    for form in ("array", "row", "agg"):
        if form in forms:
            return form
    return "const"


def key_of(ctx: Context, x: Any) -> tuple[Column, bool]:
    """A sort key and whether it descends."""
    down = False
    while isinstance(x, Call) and x.name == "desc":
        x, down = x.args[0], not down
    if isinstance(x, str):
        x = Col(x)
    v = ctx.val(x)
    return factor_rank(Val(ctx.hoist(v.col), v.form, False, v.levels) if v.window else v), down


def sort_key(ctx: Context, x: Any, reverse: bool = False) -> Column:
    """A sort column; missing values come last either way."""
    col, down = key_of(ctx, x)
    return col.desc_nulls_last() if down != reverse else col.asc_nulls_last()


def factor_rank(v: Val) -> Column:
    """Factors sort by level."""
    if v.levels is None:
        return v.col
    return F.when(v.col.isNotNull(), F.array_position(F.array(*[F.lit(x) for x in v.levels[0]]), v.col)) if v.levels[0] else v.col


NUMERIC = (T.NumericType,)


def is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def is_float(kind: T.DataType) -> bool:
    return isinstance(kind, (T.FloatType, T.DoubleType))


def divided(a: Column, b: Column, literal_divisor: Any = None) -> Column:
    """IEEE division: x/0 is infinite, 0/0 missing."""
    a, b = a.cast("double"), b.cast("double")
    if isinstance(literal_divisor, (int, float)) and literal_divisor:
        return a / b
    return F.when(b != 0, a / b).when(b.isNull() | a.isNull() | (a == 0) | F.isnan(a), F.lit(None)).when(a > 0, F.lit(math.inf)).otherwise(F.lit(-math.inf))


def lower_op(ctx: Context, x: Op) -> Val:
    values = [ctx.val(a) for a in x.args]
    form, window = combined(values), any(v.window for v in values)
    if form == "array" and any(v.form == "array" for v in values):
        return lower_array_op(ctx, x.symbol, values)
    return Val(scalar_op(ctx, x.symbol, [v.col for v in values], x.args), form, window)


def scalar_op(ctx: Context, symbol: str, cols: list[Column], args=()) -> Column:
    if symbol == "neg":
        return -cols[0]
    if symbol == "~":
        return ~cols[0].cast("boolean")
    a, b = cols
    if symbol in ("+", "-", "*"):
        ka, kb = ctx.dtype(a), ctx.dtype(b)
        if symbol == "+" and isinstance(ka, T.StringType) and isinstance(kb, T.StringType):
            return F.concat(a, b)
        a = a.cast("bigint") if isinstance(ka, (T.IntegerType, T.ShortType, T.ByteType, T.BooleanType)) and not isinstance(kb, T.DateType) else a
        b = b.cast("bigint") if isinstance(kb, (T.IntegerType, T.ShortType, T.ByteType, T.BooleanType)) and not isinstance(ka, T.DateType) else b
        if isinstance(ka, T.DateType) and is_number(kb):
            return F.date_add(a, b.cast("int")) if symbol == "+" else F.date_sub(a, b.cast("int"))
        return a + b if symbol == "+" else a - b if symbol == "-" else a * b
    if symbol == "/":
        return divided(a, b, args[1] if len(args) > 1 else None)
    if symbol == "//":
        whole = not is_float(ctx.dtype(a)) and not is_float(ctx.dtype(b))
        out = F.floor(divided(a, b, args[1] if len(args) > 1 else None))
        return out.cast("bigint") if whole else out.cast("double")
    if symbol == "%":
        return F.when(b == 0, F.lit(None)).otherwise(((a % b) + b) % b)
    if symbol == "**":
        whole = not is_float(ctx.dtype(a)) and isinstance(args[1] if len(args) > 1 else None, int) and args[1] >= 0
        return F.pow(a, b).cast("bigint") if whole else F.pow(a, b)
    if symbol in ("&", "|", "^"):
        a, b = a.cast("boolean"), b.cast("boolean")
        return a & b if symbol == "&" else a | b if symbol == "|" else a != b
    return {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[symbol]


def lower_array_op(ctx: Context, symbol: str, values: list[Val]) -> Val:
    """Operators on vectors inside a row, element by element."""
    if len(values) == 1:
        return Val(F.transform(values[0].col, lambda v: scalar_simple(symbol, v, v)), "array")
    a, b = values
    if a.form == "array" and b.form == "array":
        return Val(F.zip_with(a.col, b.col, lambda p, q: scalar_simple(symbol, p, q)), "array")
    if a.form == "array":
        return Val(F.transform(a.col, lambda p: scalar_simple(symbol, p, b.col)), "array")
    return Val(F.transform(b.col, lambda q: scalar_simple(symbol, a.col, q)), "array")


def scalar_simple(symbol: str, a: Column, b: Column) -> Column:
    table = {
        "neg": lambda: -a, "~": lambda: ~a, "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: divided(a, b), "//": lambda: F.floor(divided(a, b)),
        "%": lambda: F.when(b != 0, ((a % b) + b) % b), "**": lambda: F.pow(a, b), "&": lambda: a & b, "|": lambda: a | b, "^": lambda: a != b,
        "==": lambda: a == b, "!=": lambda: a != b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b,
    }
    return table[symbol]()


#: Methods of an expression and the functions they stand for.
METHODS = {
    "mean": "mean", "sum": "sum", "min": "min", "max": "max", "std": "sd", "var": "var", "median": "median", "prod": "prod", "count": "length", "nunique": "n_distinct",
    "first": "first", "last": "last", "any": "any", "all": "all", "abs": "abs", "round": "round", "isna": "is_na", "isnull": "is_na", "notna": None, "cumsum": "cumsum",
    "cumprod": "cumprod", "cummax": "cummax", "cummin": "cummin", "shift": "lag", "fillna": "coalesce", "astype": None, "isin": "is_element", "quantile": "quantile",
}
STR_METHODS = {"upper": "toupper", "lower": "tolower", "strip": "trimws", "len": "nchar", "startswith": "startswith", "endswith": "endswith", "contains": None, "replace": None, "split": None, "cat": "paste0"}
DT_FIELDS = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second, "dayofweek": F.weekday, "dayofyear": F.dayofyear, "quarter": F.quarter, "date": F.to_date}


def lower_method(ctx: Context, x: Method) -> Val:
    parent = x.parent
    if isinstance(parent, Attr) and parent.attr in ("str", "dt"):
        base = parent.parent
        if x.name == "contains":
            return ctx.val(Call("grepl", (x.args[0], base)))
        if x.name == "replace":
            return ctx.val(Call("gsub", (x.args[0], x.args[1], base)))
        if x.name == "split":
            return ctx.val(Call("strsplit", (base, x.args[0])))
        if x.name in STR_METHODS:
            return ctx.val(Call(STR_METHODS[x.name], (base, *x.args), x.kwargs))
        raise AttributeError(f"method {x.name!r} is not known")
    if x.name == "notna":
        return ctx.val(~Call("is_na", (parent,)))
    if x.name == "astype":
        return Val(ctx.col(parent).cast({"int": "bigint", "float": "double", "str": "string", "bool": "boolean"}.get(getattr(x.args[0], "__name__", x.args[0]), x.args[0])), ctx.val(parent).form)
    if METHODS.get(x.name):
        return ctx.val(Call(METHODS[x.name], (parent, *x.args), x.kwargs))
    raise AttributeError(f"method {x.name!r} is not known")


def lower_item(ctx: Context, x: Item) -> Val:
    """``f.x[cond]`` keeps the values where the condition holds; ``f.x[2]`` takes one."""
    if isinstance(x.key, Expr):
        cond = ctx.row(x.key) if ctx.mode == "agg" else ctx.col(x.key)
        return Val(F.when(cond, ctx.col(x.parent)))
    if isinstance(x.key, int):
        return ctx.val(Call("nth", (x.parent, x.key)))
    if isinstance(x.key, str):
        return Val(ctx.col(x.parent).getField(x.key))
    raise TypeError("an expression is indexed by a condition, a position or a field")


# ---------------------------------------------------------------- plain data
def evaluate(fn, args: tuple, kwargs: dict) -> Any:
    """A function on plain vectors: they become the columns of a small frame."""
    vectors, out_args = {}, []
    scalar = True
    for i, a in enumerate(args):
        if isinstance(a, (pd.Series, np.ndarray)):
            a = a.tolist()
        if isinstance(a, (list, tuple, range)) and not isinstance(a, str) and i in VECTOR_ARGS.get(fn.__name__, range(9)):
            vectors[f"a{i}"] = list(a)
            out_args.append(Col(f"a{i}"))
            scalar = False
        elif (fn.kind in ("agg", "window") or i == 0) and not isinstance(a, str) and not callable(a) and i == 0:
            vectors[f"a{i}"] = [a]
            out_args.append(Col(f"a{i}"))
        else:
            out_args.append(a)
    n = max(map(len, vectors.values()), default=1)
    frame = frame_of({k: v * n if len(v) == 1 else v for k, v in vectors.items()} or {"a": [None]})
    from verbena.operators.mutate import mutate
    from verbena.operators.summarise import summarise

    call = Call(fn.__name__, tuple(out_args), kwargs)
    if fn.kind in ("agg", "summary"):
        got = [plain(r[-1]) for r in summarise(frame, out=call).collect()]
        return got[0] if len(got) == 1 else got
    got = mutate(frame, out=call).to_dict()["out"]
    got = [plain(v) for v in got]
    return got[0] if scalar and len(got) == 1 else got


#: Arguments that are vectors where not all are.
VECTOR_ARGS = {"is_element": (0,), "match": (0,), "quantile": (0,), "cut": (0,), "between": (0,), "recode": (0,), "case_match": (0,), "grepl": (1,), "sub": (2,), "gsub": (2,), "factor": (0,), "full_seq": (0,)}


def plain(v: Any) -> Any:
    if isinstance(v, T.Row):
        return complex(v["re"], v["im"]) if set(v.asDict()) == {"re", "im"} else v.asDict()
    return v
