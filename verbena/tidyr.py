"""Reshaping and missing values."""

# ruff: noqa: F401
from verbena._exports import exported as _exported
from verbena.expr import c, f
from verbena.functions.scalar import full_seq
from verbena.operators.replace import replace_na
from verbena.operators.reshape import chop, complete, crossing, expand, expand_grid, extract, fill, nest, nesting, pack, pivot_longer, pivot_wider, separate, separate_rows, unchop, unite, unnest, unpack
from verbena.operators.rows import drop_na, uncount

__all__ = _exported(globals())
