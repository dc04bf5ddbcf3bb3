"""numpy on expressions."""

# ruff: noqa: F401
from verbena._exports import exported as _exported
from verbena.functions.math import array_ufunc

__all__ = _exported(globals())
