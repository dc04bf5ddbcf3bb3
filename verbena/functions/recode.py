"""Recoding into factors."""

from __future__ import annotations

from verbena.expr import Call, function
from verbena.frame import Val, missing
from verbena.functions.factor import Factor
from verbena.functions.scalar import recoding


def new_levels(args, kwargs, default, missing_value, rest: list) -> list:
    """Levels in the order of the replacements, then what is kept, the default and the missing."""
    out = [v for _, v in recoding(args, kwargs) if not missing(v)]
    out += [default] if default is not None else rest
    return list(dict.fromkeys(out + ([missing_value] if missing_value is not None else [])))


def _plain(_x, *args, _default=None, _missing=None, _ordered=False, **kwargs):
    pairs = dict(recoding(args, kwargs))
    values = [(_missing if missing(v) else pairs[v] if v in pairs else v if _default is None else _default) for v in _x]
    same = {type(v) for v in pairs.values()}
    values = [v if v is None or type(v) in same or v in (_default, _missing) else None for v in values]
    rest = [v for v in dict.fromkeys(_x) if not missing(v) and v not in pairs and type(v) in same]
    return Factor(values, new_levels(args, kwargs, _default, _missing, rest), _ordered)


@function("row", eager=_plain)
def recode_factor(ctx, _x, *args, _default=None, _missing=None, _ordered=False, **kwargs):
    """``recode`` into a factor whose levels are in the order of the replacements."""
    from verbena.functions.factor import levels_of

    col = ctx.val(Call("recode", (_x, *args), {"_default": _default, "_missing": _missing, **kwargs}))
    pairs = dict(recoding(args, kwargs))
    rest = [k for k in levels_of(ctx, ctx.val(_x)) if k not in pairs and isinstance(k, str)] if _default is None else []
    return Val(col.col, col.form, col.window, (new_levels(args, kwargs, _default, _missing, rest), _ordered))
