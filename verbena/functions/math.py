"""Numeric functions of one value."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verbena.expr import Call, function
from verbena.frame import Val, is_float

NAN, INF = float("nan"), float("inf")


def elementwise(name: str, make, doc: str | None = None):
    """A function of one column; under vectors, of each element."""

    def lower(ctx, x, *args, **kwargs):
        v = ctx.val(x)
        if v.form == "array":
            return Val(F.transform(v.col, lambda e: make(e, *args, **kwargs)), "array")
        return Val(make(v.col, *args, **kwargs), v.form, v.window)

    lower.__doc__ = doc or f"{name} of each value."
    return function("row", name)(lower)


def positive_log(fn):
    """A logarithm with IEEE results: -Inf at 0, NaN below."""

    def make(x: Column) -> Column:
        x = x.cast("double")
        return F.when(x > 0, fn(x)).when(x == 0, F.lit(-INF)).when(x < 0, F.lit(NAN))

    return make


def truncated(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


def significant(x: Column, digits: int = 6) -> Column:
    scale = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.rint(x * scale) / scale)


def log_base(x: Column, base: float = math.e) -> Column:
    out = positive_log(F.log)(x)
    return out if base == math.e else out / math.log(base)


ceiling = elementwise("ceiling", F.ceil)
floor = elementwise("floor", F.floor)
trunc = elementwise("trunc", truncated)
sign = elementwise("sign", F.signum)
abs_ = elementwise("abs", F.abs)
sqrt = elementwise("sqrt", lambda x: F.sqrt(x.cast("double")))
exp = elementwise("exp", F.exp)
log = elementwise("log", log_base)
log2 = elementwise("log2", positive_log(F.log2))
log10 = elementwise("log10", positive_log(F.log10))
log1p = elementwise("log1p", lambda x: F.when(x > -1, F.log1p(x)).when(x == -1, F.lit(-INF)).when(x < -1, F.lit(NAN)))
signif = elementwise("signif", significant)
acos, acosh, asin, asinh = (elementwise(n, getattr(F, n)) for n in ("acos", "acosh", "asin", "asinh"))
atan, atanh, cos, cosh = (elementwise(n, getattr(F, n)) for n in ("atan", "atanh", "cos", "cosh"))
sin, sinh, tan, tanh = (elementwise(n, getattr(F, n)) for n in ("sin", "sinh", "tan", "tanh"))
cospi = elementwise("cospi", lambda x: F.cos(x * math.pi))
sinpi = elementwise("sinpi", lambda x: F.sin(x * math.pi))
tanpi = elementwise("tanpi", lambda x: F.tan(x * math.pi))


@function("row", "round")
def round_(ctx, x, digits=0):
    """Round to digits, halves to the even neighbour."""
    v = ctx.val(x)
    if v.form == "array":
        return Val(F.transform(v.col, lambda e: F.bround(e, digits)), "array")
    if not is_float(ctx.dtype(v.col)):
        return v if digits >= 0 else Val(F.bround(v.col, digits), v.form, v.window)
    return Val(F.bround(v.col, digits), v.form, v.window)


@function("row")
def atan2(ctx, y, x):
    """Angle of the point (x, y)."""
    return Val(F.atan2(ctx.col(y), ctx.col(x)))


@function("row")
def identity(ctx, x):
    """Its argument."""
    return ctx.val(x)


identity.eager = lambda x: x


# ---------------------------------------------------------------- special functions
def lgamma_column(x: Column) -> Column:
    """Logarithm of |gamma(x)| by Lanczos' approximation (g = 7, nine terms)."""
    # Lanczos' coefficients.
    terms = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)

    def right(z: Column) -> Column:
        z = z - 1
        total = F.lit(terms[0])
        for i, c in enumerate(terms[1:], 1):
            total = total + F.lit(c) / (z + i)
        t = z + 7.5
        return F.lit(0.5 * math.log(2 * math.pi)) + (z + 0.5) * F.log(t) - t + F.log(total)

    x = x.cast("double")
    # the series stands in the expression once: of the mirrored argument left of one half
    value = right(F.when(x < 0.5, 1 - x).otherwise(x))
    pole = (x <= 0) & (x == F.floor(x))
    mirror = F.when(x < 0.5, F.lit(math.log(math.pi)) - F.log(F.abs(F.sin(F.lit(math.pi) * x))))
    return F.when(pole, F.lit(INF)).when(x.isin(1.0, 2.0), F.lit(0.0)).otherwise(F.coalesce(mirror - value, value))


def gamma_column(x: Column) -> Column:
    x = x.cast("double")
    sign = F.when((x < 0) & (F.pmod(F.floor(x), F.lit(2)) != 0), -1.0).otherwise(1.0)
    whole = (x == F.floor(x)) & (x >= 1) & (x <= 21)
    return F.when((x <= 0) & (x == F.floor(x)), F.lit(NAN)).when(whole, F.factorial(F.when(whole, x - 1).otherwise(F.lit(0)).cast("int")).cast("double")).otherwise(sign * F.exp(lgamma_column(x)))


lgamma = elementwise("lgamma", lgamma_column)
gamma = elementwise("gamma", gamma_column)
factorial = elementwise("factorial", lambda x: gamma_column(x + 1))
lfactorial = elementwise("lfactorial", lambda x: lgamma_column(x + 1))


def polygamma_values(x: np.ndarray, order: int) -> np.ndarray:
    """Derivatives of the logarithm of gamma by recurrence and asymptotic series."""
    x = np.asarray(x, float)
    out = np.full(x.shape, np.nan)
    good = ~(np.isnan(x) | ((x <= 0) & (x == np.floor(x))))
    z = x[good].copy()
    # Bernoulli numbers B2, B4, ...
    bernoulli = (1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66, -691 / 2730, 7 / 6, -3617 / 510)
    total = np.zeros_like(z)
    fact = math.factorial(order)
    for _ in range(400):
        small = z < 15
        if not small.any():
            break
        total[small] += (-1) ** (order + 1) * fact / z[small] ** (order + 1) if order else -1 / z[small]
        z[small] += 1
    if order == 0:
        series = np.log(z) - 0.5 / z - sum(b / (2 * k * z ** (2 * k)) for k, b in enumerate(bernoulli, 1))
    else:
        series = math.factorial(order - 1) / z**order + fact / (2 * z ** (order + 1)) + sum(b * math.factorial(2 * k + order - 1) / (math.factorial(2 * k) * z ** (2 * k + order)) for k, b in enumerate(bernoulli, 1))
        series *= (-1) ** (order + 1)
    out[good] = total + series
    return out


def vectorised(name: str, compute, parameters: int = 1, doc: str = ""):
    """A function of numpy arrays as an Arrow-batched UDF."""

    def lower(ctx, *args, **kwargs):
        cols = [ctx.col(a).cast("double") for a in args[:parameters]]
        rest = args[parameters:]

        if parameters == 1:

            @F.pandas_udf("double")
            def udf(x: pd.Series) -> pd.Series:
                return pd.Series(np.asarray(compute(x.to_numpy(float), *rest, **kwargs), float)).where(x.notna())

        else:

            @F.pandas_udf("double")
            def udf(x: pd.Series, y: pd.Series) -> pd.Series:
                return pd.Series(np.asarray(compute(x.to_numpy(float), y.to_numpy(float), *rest, **kwargs), float)).where(x.notna() & y.notna())

        return Val(udf(*cols))

    lower.__doc__ = doc or name
    return function("row", name)(lower)


digamma = vectorised("digamma", lambda x: polygamma_values(x, 0), doc="First derivative of the logarithm of gamma.")
trigamma = vectorised("trigamma", lambda x: polygamma_values(x, 1), doc="Second derivative of the logarithm of gamma.")
psigamma = vectorised("psigamma", lambda x, deriv=0: polygamma_values(x, int(deriv)), doc="Polygamma function.")


def quadrature(fn, low: float, high: float, n: int = 4001):
    """Simpson's rule."""
    t = np.linspace(low, high, n)
    w = np.ones(n)
    w[1:-1:2], w[2:-1:2] = 4, 2
    return (fn(t) * w).sum(axis=-1) * (high - low) / (n - 1) / 3


def by_pair(compute):
    """A function of arrays from one of two numbers: each pair of them is computed once."""

    def values(x, nu, *rest, **kwargs):
        x, nu = np.broadcast_arrays(np.asarray(x, float), np.asarray(nu, float))
        bits = np.stack([np.ascontiguousarray(v).reshape(-1).view(np.int64) for v in (x, nu)], axis=1)
        pairs, back = np.unique(bits, axis=0, return_inverse=True)
        out = np.array([compute(a, v, *rest, **kwargs) for a, v in np.ascontiguousarray(pairs).view(float)], float)
        return out[back.reshape(-1)].reshape(x.shape)

    return values


@by_pair
def bessel_j_values(a, v):
    first = quadrature(lambda t: np.cos(v * t - a * np.sin(t)), 0, math.pi) / math.pi
    rest = 0.0 if v == int(v) else math.sin(v * math.pi) / math.pi * quadrature(lambda t: np.exp(-a * np.sinh(t) - v * t), 0, tail_end(a, v))
    return first - rest


def tail_end(x: float, nu: float) -> float:
    """Where exp(-x sinh t) has died down."""
    return math.asinh(max(750.0 / max(x, 1e-8), 1.0)) + 1


@by_pair
def bessel_y_values(a, v):
    first = quadrature(lambda t: np.sin(a * np.sin(t) - v * t), 0, math.pi) / math.pi
    rest = quadrature(lambda t: (np.exp(v * t) + np.exp(-v * t) * math.cos(v * math.pi)) * np.exp(-a * np.sinh(t)), 0, tail_end(a, v), 20001) / math.pi
    return first - rest


@by_pair
def bessel_i_values(a, v, expon_scaled=False):
    first = quadrature(lambda t: np.exp(a * (np.cos(t) - 1)) * np.cos(v * t), 0, math.pi) / math.pi
    rest = 0.0 if v == int(v) else math.sin(v * math.pi) / math.pi * quadrature(lambda t: np.exp(-a * (np.cosh(t) + 1) - v * t), 0, tail_end(a, v))
    return (first - rest) * (1 if expon_scaled else math.exp(a))


@by_pair
def bessel_k_values(a, v, expon_scaled=False):
    return quadrature(lambda t: np.exp(-a * (np.cosh(t) - 1)) * np.cosh(v * t), 0, tail_end(a, v), 20001) * (1 if expon_scaled else math.exp(-a))


bessel_j = vectorised("bessel_j", bessel_j_values, 2, "Bessel function of the first kind.")
bessel_y = vectorised("bessel_y", bessel_y_values, 2, "Bessel function of the second kind.")
bessel_i = vectorised("bessel_i", bessel_i_values, 2, "Modified Bessel function of the first kind.")
bessel_k = vectorised("bessel_k", bessel_k_values, 2, "Modified Bessel function of the second kind.")


@function("row")
def lbeta(ctx, x, y):
    """Logarithm of the beta function."""
    a, b = ctx.col(x).cast("double"), ctx.col(y).cast("double")
    return Val(lgamma_column(a) + lgamma_column(b) - lgamma_column(a + b))


@function("row")
def beta(ctx, x, y):
    """Beta function."""
    return Val(F.exp(ctx.col(Call("lbeta", (x, y)))))


@function("row")
def lchoose(ctx, n, k):
    """Logarithm of the binomial coefficient."""
    a, b = ctx.col(n).cast("double"), ctx.col(k).cast("double")
    return Val(F.when((b < 0) | (b > a), F.lit(-INF)).otherwise(lgamma_column(a + 1) - lgamma_column(b + 1) - lgamma_column(a - b + 1)))


@function("row")
def choose(ctx, n, k):
    """Binomial coefficient."""
    return Val(F.rint(F.exp(ctx.col(Call("lchoose", (n, k))))))


# ---------------------------------------------------------------- complex numbers
def parts(ctx, x) -> tuple[Column, Column]:
    """Real and imaginary part; a complex number is a struct of two doubles."""
    col = ctx.col(x)
    if isinstance(ctx.dtype(col), T.StructType):
        return col.getField("re"), col.getField("im")
    return col.cast("double"), F.when(col.isNotNull(), F.lit(0.0))


def complex_column(re_: Column, im_: Column) -> Column:
    return F.struct(re_.alias("re"), im_.alias("im"))


@function("row")
def as_complex(ctx, x):
    """A complex number (struct of re and im)."""
    col = ctx.col(x)
    if isinstance(ctx.dtype(col), T.StringType):
        pattern = r"^\(?([+-]?[0-9.eE]+)?(?:([+-]?[0-9.eE]*)[ij])?\)?$"
        return Val(complex_column(F.regexp_extract(col, pattern, 1).try_cast("double"), F.coalesce(F.regexp_extract(col, pattern, 2).try_cast("double"), F.lit(0.0))))
    return Val(complex_column(*parts(ctx, x)))


@function("row")
def mod(ctx, x):
    """Absolute value of a complex number."""
    return Val(F.hypot(*parts(ctx, x)))


@function("row")
def arg(ctx, x):
    """Angle of a complex number."""
    a, b = parts(ctx, x)
    return Val(F.atan2(b, a))


@function("row")
def conj(ctx, x):
    """Complex conjugate."""
    a, b = parts(ctx, x)
    return Val(complex_column(a, -b))


@function("row", "re")
def re_(ctx, x):
    """Real part."""
    return Val(parts(ctx, x)[0])


@function("row")
def im(ctx, x):
    """Imaginary part."""
    return Val(parts(ctx, x)[1])


# ---------------------------------------------------------------- numpy on expressions
#: numpy functions and the functions they stand for.
UFUNCS = {
    "sqrt": "sqrt", "exp": "exp", "log": "log", "log2": "log2", "log10": "log10", "log1p": "log1p", "sin": "sin", "cos": "cos", "tan": "tan", "arcsin": "asin", "arccos": "acos",
    "arctan": "atan", "sinh": "sinh", "cosh": "cosh", "tanh": "tanh", "arcsinh": "asinh", "arccosh": "acosh", "arctanh": "atanh", "absolute": "abs", "floor": "floor", "ceil": "ceiling",
    "trunc": "trunc", "sign": "sign", "rint": "round", "arctan2": "atan2", "isnan": "is_na", "isfinite": "is_finite", "isinf": "is_infinite", "minimum": "pmin", "maximum": "pmax",
}
UFUNC_OPERATORS = {"add": "+", "subtract": "-", "multiply": "*", "true_divide": "/", "divide": "/", "floor_divide": "//", "remainder": "%", "power": "**", "equal": "==", "not_equal": "!=", "less": "<", "less_equal": "<=", "greater": ">", "greater_equal": ">=", "logical_and": "&", "logical_or": "|", "logical_not": "~", "negative": "neg"}


def _ufunc_plain(x, ufunc, *args, kind=None, **kwargs):
    return ufunc(x, *args, **kwargs)


@function("row", eager=_ufunc_plain)
def array_ufunc(ctx, x, ufunc, *args, kind=None, **kwargs):
    """A numpy ufunc on an expression: the function of the grammar it stands for, otherwise the
    ufunc itself on Arrow batches."""
    from verbena.expr import Op

    name = ufunc.__name__
    if name in UFUNC_OPERATORS:
        return Op(UFUNC_OPERATORS[name], (x, *args))
    if name in UFUNCS:
        return Call(UFUNCS[name], (x, *args))

    @F.pandas_udf("double")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(ufunc(v.to_numpy(float), *args, **kwargs))

    return Val(run(ctx.col(x).cast("double")))
