"""Functions of vectors: arithmetic, statistics, strings, dates, factors, sequences, random
numbers, sets and matrices."""

# ruff: noqa: F401
import math as _math

from verbena._exports import CONFLICTS as _CONFLICTS
from verbena._exports import conflict_access as _conflict_access
from verbena._exports import exported as _exported
from verbena.expr import c, f
from verbena.functions.aggregate import all_, any_, any_na, approx_n_distinct, cov, length, max_, max_col, mean, median, min_, pmax, pmin, prod, quantile, row_means, row_medians, row_sds, row_sums, sd, sum_, var, weighted_mean, which, which_max, which_min
from verbena.functions.factor import as_categorical, as_factor, as_ordered, droplevels, factor, is_categorical, is_factor, is_ordered, levels, nlevels, ordered, set_levels
from verbena.functions.math import abs_, acos, acosh, arg, as_complex, asin, asinh, atan, atan2, atanh, bessel_i, bessel_j, bessel_k, bessel_y, beta, ceiling, choose, conj, cos, cosh, cospi, digamma, exp, factorial, floor, gamma, identity, im, lbeta, lchoose, lfactorial, lgamma, log, log1p, log2, log10, mod, psigamma, re_, round_, sign, signif, sin, sinh, sinpi, sqrt, tan, tanh, tanpi, trigamma, trunc
from verbena.functions.random import rbinom, rcauchy, rchisq, rexp, rnorm, rpois, runif, sample, set_seed
from verbena.functions.scalar import append, as_bool, as_character, as_date, as_double, as_float, as_int, as_integer, as_logical, as_null, as_numeric, as_pd_date, as_str, as_string, c_, complete_cases, cut, is_atomic, is_bool, is_character, is_complex, is_double, is_element, is_false, is_finite, is_in, is_infinite, is_int, is_integer, is_logical, is_na, is_nan, is_null, is_numeric, is_str, is_string, is_true, lengths, match, order, rep, rev, seq, seq_along, seq_len, sort
from verbena.functions.scalar import is_float_ as is_float
from verbena.functions.text import chartr, endswith, grep, grepl, gsub, nchar, nzchar, paste, paste0, sprintf, startswith, strsplit, strtoi, sub, substr, substring, tolower, toupper, trimws
from verbena.functions.window import cummax, cummin, cumprod, cumsum, diff, duplicated, prop_table, proportions, rank, scale
from verbena.names import make_names, make_unique
from verbena.operators.reshape import expand_grid
from verbena.operators.rows import head, tail, unique
from verbena.operators.select import colnames, dim, ncol, nrow, set_colnames
from verbena.operators.sets import intersect, setdiff, setequal, union
from verbena.operators.summarise import col_means, col_medians, col_sds, col_sums, cov_matrix, table, tabulate
from verbena.operators.tibble import diag, outer, rownames, set_rownames, t

std = sd
pi = _math.pi
letters = [chr(97 + i) for i in range(26)]
LETTERS = [x.upper() for x in letters]
month_name = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
month_abb = [x[:3] for x in month_name]
FALSE, TRUE = False, True
NA = NaN = float("nan")
NULL = None
Inf = float("inf")

__all__ = _exported(globals(), _CONFLICTS["base"])
__getattr__ = _conflict_access(globals(), _CONFLICTS["base"])
