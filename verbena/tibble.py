"""Making frames and row names."""

# ruff: noqa: F401
from verbena._exports import exported as _exported
from verbena.expr import c, f
from verbena.operators.tibble import add_case, add_column, add_row, as_data_frame, as_tibble, column_to_index, column_to_rownames, deframe, drop_index, enframe, has_index, has_rownames, index_to_column, remove_index, remove_rownames, rowid_to_column, rownames_to_column, tibble, tibble_, tibble_row, tribble

__all__ = _exported(globals())
