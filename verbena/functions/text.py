"""String functions. Patterns are regular expressions of Java unless ``fixed``."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verbena.expr import function
from verbena.frame import Val
from verbena.functions.aggregate import applied

#: Whether positions of substrings count from 0 (stop exclusive).
ZERO_BASED = True


def pattern_of(pattern: str, ignore_case: bool, fixed: bool) -> str:
    if fixed:
        pattern = re.escape(pattern)
    return f"(?i){pattern}" if ignore_case else pattern


def text(ctx, x) -> Column:
    col = ctx.col(x)
    return col if isinstance(ctx.dtype(col), (T.StringType, T.ArrayType)) else col.cast("string")


def java_replacement(replacement: str, fixed: bool) -> str:
    r"""``\1`` as ``$1``; dollar signs are plain."""
    replacement = replacement.replace("\\", "\\\\") if fixed else replacement
    replacement = replacement.replace("$", r"\$")
    return replacement if fixed else re.sub(r"\\(\d)", r"$\1", replacement)


@function("row")
def grepl(ctx, pattern, x, ignore_case=False, fixed=False):
    """Whether the pattern occurs; false for missing values."""
    col = text(ctx, x)
    found = F.contains(col, F.lit(pattern)) if fixed and not ignore_case else col.rlike(pattern_of(pattern, ignore_case, fixed))
    return Val(F.coalesce(found, F.lit(False)), ctx.val(x).form)


@function("agg")
def grep(ctx, pattern, x, ignore_case=False, value=False, fixed=False, invert=False):
    """0-based positions (or values) of the elements in which the pattern occurs."""
    col = ctx.row(x)
    hit = F.coalesce(col.rlike(pattern_of(pattern, ignore_case, fixed)), F.lit(False))
    hit = ~hit if invert else hit
    position = ctx.position()

    def run(A):
        rows = F.array_sort(A(F.collect_list(F.when(hit, F.struct(position.alias("p"), col.alias("v"))))))
        return F.transform(rows, lambda r: r.getField("v" if value else "p"))

    return applied(ctx, run, vector=True)


def _replace(ctx, pattern, replacement, x, ignore_case, fixed, first) -> Val:
    col = text(ctx, x)
    regex, new = pattern_of(pattern, ignore_case, fixed), java_replacement(replacement, fixed)
    if first:  # what stands before and behind the match are groups of their own
        groups = 0 if fixed else re.compile(pattern).groups
        shifted = re.sub(r"\$(\d)", lambda m: f"${int(m[1]) + 1}", new)
        out = F.regexp_replace(col, f"^(?s:(.*?))(?:{regex})(?s:(.*))$", f"$1{shifted}${groups + 2}")
    else:
        out = F.regexp_replace(col, regex, new)
    return Val(out, ctx.val(x).form)


@function("row")
def sub(ctx, pattern, replacement, x, ignore_case=False, fixed=False):
    """Replace the first match."""
    return _replace(ctx, pattern, replacement, x, ignore_case, fixed, True)


@function("row")
def gsub(ctx, pattern, replacement, x, ignore_case=False, fixed=False):
    """Replace all matches."""
    return _replace(ctx, pattern, replacement, x, ignore_case, fixed, False)


@function("row")
def strsplit(ctx, x, split, fixed=False, perl=False, use_bytes=False):
    """Pieces between matches."""
    return Val(F.split(text(ctx, x), re.escape(split) if fixed else split), "array" if ctx.frame.rowwise else "row")


def joined(ctx, args, sep, collapse) -> Val:
    cols = [F.coalesce(ctx.row(a).cast("string") if collapse is not None else ctx.col(a).cast("string"), F.lit("NA")) for a in args]
    out = F.concat_ws(sep, *cols)
    if collapse is None:
        return Val(out, "row" if any(ctx.val(a).form == "row" for a in args) else ctx.val(args[0]).form)
    position = ctx.position()

    def run(A):
        rows = F.array_sort(A(F.collect_list(F.struct(position.alias("p"), out.alias("v")))))
        return F.array_join(F.transform(rows, lambda r: r.getField("v")), collapse)

    return applied(ctx, run)


@function("row")
def paste(ctx, *args, sep=" ", collapse=None):
    """Join values element by element; with ``collapse`` all of a group into one string."""
    return joined(ctx, args, sep, collapse)


@function("row")
def paste0(ctx, *args, sep="", collapse=None):
    """``paste`` without a separator."""
    return joined(ctx, args, sep, collapse)


@function("row")
def sprintf(ctx, fmt, *args):
    """C-style formatting."""
    specs = re.findall(r"%[-+ #0]*\d*(?:\.\d+)?([a-zA-Z%])", fmt)
    kinds = [s for s in specs if s != "%"]
    cast = {"d": "bigint", "i": "bigint", "x": "bigint", "X": "bigint", "o": "bigint", "f": "double", "e": "double", "E": "double", "g": "double", "G": "double", "s": "string"}
    cols = [ctx.col(a).cast(cast[k]) for a, k in zip(args, kinds, strict=True)]
    return Val(F.format_string(re.sub(r"(%[-+ #0]*\d*)i", r"\1d", fmt), *cols))


@function("row")
def substr(ctx, x, start, stop):
    """Characters from ``start`` up to ``stop`` (0-based, stop exclusive)."""
    first = start if ZERO_BASED else start - 1
    return Val(F.substring(text(ctx, x), first + 1, max(stop - first, 0)), ctx.val(x).form)


@function("row")
def substring(ctx, x, first, last=None):
    """Characters from ``first`` up to ``last`` or the end."""
    col = text(ctx, x)
    size = F.length(col) if last is None else F.lit(max(last - first, 0))
    return Val(F.substring(col, F.lit(first + 1 if ZERO_BASED else first), size), ctx.val(x).form)


@function("row")
def startswith(ctx, x, prefix):
    """Whether a value starts with the prefix."""
    return Val(F.startswith(text(ctx, x), ctx.col(prefix)), ctx.val(x).form)


@function("row")
def endswith(ctx, x, suffix):
    """Whether a value ends with the suffix."""
    return Val(F.endswith(text(ctx, x), ctx.col(suffix)), ctx.val(x).form)


@function("row")
def strtoi(ctx, x, base=0):
    """Integer written in a base; base 0 reads the prefix (0x, 0, 0b)."""
    col = F.lower(F.trim(text(ctx, x)))
    if base:
        return Val(F.conv(col, base, 10).try_cast("bigint"))
    out = F.when(col.startswith("0x"), F.conv(F.substring(col, 3, 64), 16, 10)).when(col.startswith("0b"), F.conv(F.substring(col, 3, 64), 2, 10))
    out = out.when(col.rlike("^0o?[0-7]+$"), F.conv(F.regexp_replace(col, "^0o?", ""), 8, 10)).otherwise(col)
    return Val(out.try_cast("bigint"))


@function("row")
def trimws(ctx, x, which="both", whitespace=" \t"):
    """Strip characters from one or both ends."""
    fn = {"both": F.btrim, "left": F.ltrim, "right": F.rtrim}[which]
    return Val(fn(text(ctx, x), F.lit(whitespace)), ctx.val(x).form)


@function("row")
def toupper(ctx, x):
    """Upper case."""
    return Val(F.upper(text(ctx, x)), ctx.val(x).form)


@function("row")
def tolower(ctx, x):
    """Lower case."""
    return Val(F.lower(text(ctx, x)), ctx.val(x).form)


@function("row")
def chartr(ctx, old, new, x):
    """Replace characters one for one."""
    if len(old) > len(new):
        raise ValueError("old is longer than new")
    return Val(F.translate(text(ctx, x), old, new[: len(old)]), ctx.val(x).form)


def width_of(s: str) -> int:
    return sum(0 if unicodedata.combining(ch) else 2 if unicodedata.east_asian_width(ch) in "WF" else 1 for ch in s)


@function("row")
def nchar(ctx, x, type_="width", allow_na=True, keep_na=False, _na_len=2):
    """Characters, bytes or display width of each value; missing values count ``_na_len``."""
    col = text(ctx, x)
    if type_ == "bytes":
        out = F.octet_length(col)
    elif type_ == "chars":
        out = F.length(col)
    else:
        # plain ASCII needs no Python
        @F.pandas_udf("bigint")
        def width(v: pd.Series) -> pd.Series:
            return v.map(lambda s: width_of(s) if isinstance(s, str) else None)

        out = F.when(F.octet_length(col) == F.length(col), F.length(col)).otherwise(width(F.when(F.octet_length(col) != F.length(col), col)))
    out = out.cast("bigint")
    return Val(out if keep_na else F.coalesce(out, F.lit(_na_len).cast("bigint")), ctx.val(x).form)


@function("row")
def nzchar(ctx, x, keep_na=False):
    """Whether a value is a non-empty string; missing values count as non-empty."""
    out = F.length(text(ctx, x)) > 0
    return Val(out if keep_na else F.coalesce(out, F.lit(True)), ctx.val(x).form)
