"""Factors."""

# ruff: noqa: F401
from verbena._exports import exported as _exported
from verbena.expr import c, f
from verbena.functions.aggregate import first2, last2
from verbena.functions.factor import as_factor, fct_anon, fct_c, fct_collapse, fct_cross, fct_drop, fct_expand, fct_explicit_na, fct_infreq, fct_inorder, fct_inseq, fct_lump, fct_lump_lowfreq, fct_lump_min, fct_lump_n, fct_lump_prop, fct_match, fct_other, fct_recode, fct_relabel, fct_relevel, fct_reorder, fct_reorder2, fct_rev, fct_shift, fct_shuffle, fct_unify, fct_unique, lvls_expand, lvls_reorder, lvls_revalue, lvls_union
from verbena.operators.summarise import fct_count

__all__ = _exported(globals())
