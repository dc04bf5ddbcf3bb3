"""``replace_na`` as a verb on frames and as a function of columns and vectors."""

from __future__ import annotations

from verbena.expr import Call, VerbCall, has_expr
from verbena.frame import is_table, missing
from verbena.operators.rows import replace_na as _verb


def replace_na(data=None, data_or_replace=None, replace=None):
    """Missing values replaced: in a frame by a mapping or one value, in a column or vector by a
    value."""
    if is_table(data):
        return _verb(data, data_or_replace, replace)
    value = replace if replace is not None else data_or_replace
    if has_expr(data):
        return Call("coalesce", (data, value))
    if isinstance(data, (list, tuple)):
        return [value if missing(v) else v for v in data]
    return VerbCall(_verb, (data if data is not None else value,), {})
