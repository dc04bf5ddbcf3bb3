"""Verbs of data manipulation and the functions that go with them."""

# ruff: noqa: F401
from verbena._exports import CONFLICTS as _CONFLICTS
from verbena._exports import conflict_access as _conflict_access
from verbena._exports import exported as _exported
from verbena.expr import c, f
from verbena.functions.aggregate import first, last, n, n_distinct, nth
from verbena.functions.factor import Factor
from verbena.functions.recode import recode_factor
from verbena.functions.scalar import between, case_match, case_when, coalesce, if_else, na_if, near, recode
from verbena.functions.window import consecutive_id, cumall, cumany, cume_dist, cume_dist_, cummean, dense_rank, dense_rank_, lag, lead, min_rank, min_rank_, ntile, ntile_, order_by, percent_rank, percent_rank_, row_number, row_number_, with_order
from verbena.operators.group import group_by, group_by_drop_default, group_cols, group_data, group_indices, group_keys, group_map, group_modify, group_rows, group_size, group_split, group_trim, group_vars, group_walk, n_groups, rowwise, ungroup, with_groups
from verbena.operators.joins import anti_join, cross_join, full_join, inner_join, left_join, nest_join, right_join, rows_append, rows_delete, rows_insert, rows_patch, rows_update, rows_upsert, semi_join
from verbena.operators.mutate import across, cur_column, cur_data, cur_data_all, cur_group, cur_group_id, cur_group_rows, if_all, if_any, mutate, transmute
from verbena.operators.rows import arrange, desc, distinct, filter_, slice_, slice_head, slice_max, slice_min, slice_sample, slice_tail
from verbena.operators.select import all_of, any_of, c_across, contains, ends_with, everything, glimpse, last_col, matches, num_range, one_of, pick, pull, relocate, rename, rename_with, select, starts_with, where
from verbena.operators.sets import bind_cols, bind_rows, intersect, setdiff, setequal, symdiff, union, union_all
from verbena.operators.summarise import add_count, add_tally, count, summarise, summarize, tally

__all__ = _exported(globals(), _CONFLICTS["dplyr"])
__getattr__ = _conflict_access(globals(), _CONFLICTS["dplyr"])
