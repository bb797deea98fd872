"""Table preparation on Spark: sixteen operators, chains of them, and the jobs around them."""

from .operators.columns import best_layout, cast_column, rename_columns, select_columns
from .operators.combine import join_tables, union_tables
from .operators.grouping import group_rows
from .operators.reshape import explode_column, pivot_rows, transpose_table, unpivot_columns, wide_to_long
from .operators.rows import drop_duplicates, drop_missing, filter_rows, sort_rows, top_rows
from .plans.chain import ChainError, ChainResult, run_chain
from .plans.registry import available, lookup, register

__all__ = [
    "ChainError", "ChainResult", "available", "best_layout", "cast_column", "drop_duplicates", "drop_missing",
    "explode_column", "filter_rows", "group_rows", "join_tables", "lookup", "pivot_rows", "register",
    "rename_columns", "run_chain", "select_columns", "sort_rows", "top_rows", "transpose_table",
    "union_tables", "unpivot_columns", "wide_to_long",
]
