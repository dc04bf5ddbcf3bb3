"""Random numbers. ``set_seed`` makes them repeatable inside a session."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from verbena.expr import function
from verbena.frame import Val

_state = {"rng": np.random.default_rng(), "seed": None}


def set_seed(seed: int | None) -> None:
    """Start the random numbers anew."""
    _state["rng"], _state["seed"] = np.random.default_rng(seed), seed


def next_seed() -> int:
    return int(_state["rng"].integers(1 << 31))


def drawn(name: str, draw, native=None):
    """A generator: plain calls give a list, in a frame a number in each row, under ``rowwise``
    (or with a column as n) a vector in each row."""

    def plain(n, *params, **named):
        n = len(n) if isinstance(n, (list, tuple)) else int(n)
        return np.asarray(draw(_state["rng"], n, *params, **named), float).tolist()

    def lower(ctx, n, *params, **named):
        cols = [ctx.col(p).cast("double") for p in (*params, *named.values())]
        keys = [None] * len(params) + list(named)
        seed = next_seed()
        size = ctx.val(n)
        if size.form == "const" and not ctx.frame.rowwise and native is not None and not named:
            return Val(native(seed, *cols))
        row = F.monotonically_increasing_id()

        def make(batch: pd.DataFrame, vector: bool):
            out = []
            for values in batch.itertuples(index=False):
                rng = np.random.default_rng([seed, int(values[0])])
                given = [v for v, k in zip(values[2:], keys, strict=True) if k is None]
                extra = {k: v for v, k in zip(values[2:], keys, strict=True) if k}
                got = np.asarray(draw(rng, int(values[1]) if vector else 1, *given, **extra), float)
                out.append(got.tolist() if vector else float(got[0]))
            return pd.Series(out)

        vector = ctx.frame.rowwise or size.form == "row"

        @F.pandas_udf("array<double>" if vector else "double")
        def run(*batch: pd.Series) -> pd.Series:
            return make(pd.concat(batch, axis=1), vector)

        return Val(run(row, size.col.cast("bigint"), *cols), "array" if vector else "row")

    lower.__doc__ = f"Random numbers ({name})."
    return function("row", name, eager=plain)(lower)


rnorm = drawn("rnorm", lambda r, n, mean=0, sd=1: r.normal(mean, sd, n), lambda s, m=None, d=None: F.randn(s) * (F.lit(1.0) if d is None else d) + (F.lit(0.0) if m is None else m))
runif = drawn("runif", lambda r, n, min=0, max=1: r.uniform(min, max, n), lambda s, a=None, b=None: F.rand(s) * ((F.lit(1.0) if b is None else b) - (F.lit(0.0) if a is None else a)) + (F.lit(0.0) if a is None else a))
rexp = drawn("rexp", lambda r, n, rate=1: r.exponential(1 / rate, n), lambda s, k=None: -F.log(1 - F.rand(s)) / (F.lit(1.0) if k is None else k))
rcauchy = drawn("rcauchy", lambda r, n, location=0, scale=1: location + scale * r.standard_cauchy(n), lambda s, m=None, d=None: F.tan(np.pi * (F.rand(s) - 0.5)) * (F.lit(1.0) if d is None else d) + (F.lit(0.0) if m is None else m))
rpois = drawn("rpois", lambda r, n, lambda_: r.poisson(lambda_, n))
rbinom = drawn("rbinom", lambda r, n, size, prob: r.binomial(int(size), prob, n))
rchisq = drawn("rchisq", lambda r, n, df: r.chisquare(df, n))


def _sample_plain(x, size=None, replace=False, prob=None):
    x = list(range(x)) if isinstance(x, int) else list(x)
    size = len(x) if size is None else size
    p = None if prob is None else np.asarray(prob, float) / np.sum(prob)
    return [x[i] for i in _state["rng"].choice(len(x), size, replace=replace, p=p)]


@function("row", eager=_sample_plain)
def sample(ctx, x, size=None, replace=False, prob=None):
    """Elements of a vector at random, with or without putting back."""
    a = ctx.val(x).col
    if replace:
        drawn_ = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.get(a, F.floor(F.rand(next_seed()) * F.size(a)).cast("int")))
        return Val(drawn_, "array")
    out = F.shuffle(a)
    return Val(out if size is None else F.slice(out, 1, size), "array")
