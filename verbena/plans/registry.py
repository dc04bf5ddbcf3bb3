"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbena import all as v
from verbena.expr import Call, Col, function
from verbena.frame import Frame, Val

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query: a function of a table getter that gives a frame."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = fn(lambda name: Frame(spark.read.parquet(f"{sf_dir}/{name}.parquet")))
            df = out.df if isinstance(out, Frame) else out
            return df.select(*[F.col(f"`{c}`") for c in df.columns if not c.startswith("__")])

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return wrap


def rounded(frame: Frame, **digits: int) -> Frame:
    """Floating point sums depend on their order; both sides are rounded."""
    return v.mutate(frame, **{c: Call("round_half_up", (Col(c), d)) for c, d in digits.items()})


@function("row")
def round_half_up(ctx, x, digits):
    """Decimal rounding, halves away from zero, as SQL does."""
    value = ctx.val(x)
    return Val(F.round(value.col, digits), value.form, value.window)
