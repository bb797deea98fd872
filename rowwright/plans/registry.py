"""Operators by name, and the checks made before a plan is built.

A check looks at parameters and schemas only, so a bad chain fails before any job.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame

from ..functions.names import as_list, kind_of, require_columns
from ..operators.columns import CAST_TYPES, cast_column, rename_columns, select_columns
from ..operators.combine import join_tables, union_tables
from ..operators.grouping import group_rows
from ..operators.reshape import explode_column, pivot_rows, transpose_table, unpivot_columns, wide_to_long
from ..operators.rows import drop_duplicates, drop_missing, filter_rows, sort_rows, top_rows

Check = Callable[[dict, list[DataFrame]], None]


@dataclass(frozen=True)
class Operator:
    """A function from one table (or two) to a table, with its parameter check."""

    name: str
    apply: Callable[..., DataFrame]
    check: Check | None = None
    tables: int = 1
    ordered: bool = False  # takes the order left by an earlier sort
    narrow: bool = False  # works row by row, hence on streams as well

    def build(self, tables: list[DataFrame], params: dict[str, Any]) -> DataFrame:
        if len(tables) != self.tables:
            raise ValueError(f"{self.name}: needs {self.tables} table(s), got {len(tables)}")
        if self.check:
            self.check(params, tables)
        return self.apply(*tables, **params)


def _need(name: str, params: dict, *required: str) -> None:
    empty = [r for r in required if params.get(r) in (None, "", [], {}, ())]
    if empty:
        raise ValueError(f"{name}: missing parameters {empty}")


def _check_filter(params, tables):
    condition = params.get("condition")
    if isinstance(condition, (int, float, list, dict)):
        raise ValueError("filter: condition must be text or a column")


def _check_groupby(params, tables):
    _need("groupby", params, "by", "agg")


def _check_sort(params, tables):
    _need("sort", params, "by")


def _check_pivot(params, tables):
    _need("pivot", params, "index", "columns", "values")


def _check_unpivot(params, tables):
    _need("unpivot", params, "id_vars", "value_vars")


def _check_explode(params, tables):
    _need("explode", params, "column")
    require_columns(tables[0], [params["column"]], "explode")
    if params.get("split_comma") and kind_of(tables[0].schema[params["column"]].dataType) != "text":
        raise ValueError(f"explode: {params['column']} holds no text to split")


def _check_wide_to_long(params, tables):
    _need("wide_to_long", params, "subnames", "i")
    if not isinstance(params["subnames"], list) or not isinstance(params["i"], list):
        raise TypeError("wide_to_long: subnames and i must be lists")
    if not isinstance(params.get("sep", "_"), str):
        raise TypeError("wide_to_long: sep must be text")


def _check_join(params, tables):
    if params.get("how") == "cross" or params.get("on"):
        return
    _need("join", params, "left_on", "right_on")


def _check_union(params, tables):
    _need("union", params, "how")


def _check_transpose(params, tables):
    unknown = set(params) - {"headers"}
    if unknown:
        raise ValueError(f"transpose: takes no parameters, got {sorted(unknown)}")


def _check_how_and_subset(name: str, key: str, allowed: tuple[str, ...]) -> Check:
    def check(params, tables):
        if params.get(key, allowed[0]) not in allowed:
            raise ValueError(f"{name}: {key} must be one of {allowed}")
        require_columns(tables[0], as_list(params.get("subset")), name)
    return check


def _check_topk(params, tables):
    k = params.get("k")
    if isinstance(k, bool) or not isinstance(k, int) or k <= 0:
        raise ValueError("topk: k must be a positive whole number")


def _check_select(params, tables):
    _need("select", params, "columns")


def _check_cast(params, tables):
    _need("cast", params, "column", "dtype")
    if str(params["dtype"]).lower() not in CAST_TYPES:
        raise ValueError(f"cast: unknown type {params['dtype']!r}")
    require_columns(tables[0], [params["column"]], "cast")


def _check_rename(params, tables):
    mapping = params.get("rename_map", {})
    if not isinstance(mapping, dict) or not all(isinstance(x, str) for kv in mapping.items() for x in kv):
        raise ValueError("rename: rename_map must map names to names")


def _join(left, right, left_table=None, right_table=None, **params):
    return join_tables(left, right, **params)


def _union(left, right, left_table=None, right_table=None, how="all"):
    return union_tables(left, right, how)


def _explode(df, column, split_comma=False, mode="auto"):
    return explode_column(df, column, split_comma, mode)


def _rename(df, rename_map=None, mode="replace"):
    return rename_columns(df, rename_map or {}, mode)


_OPERATORS: dict[str, Operator] = {}
# Other names of three operators.
ALIASES = {"where": "filter", "orderby": "sort", "astype": "cast"}


def register(name: str, apply: Callable[..., DataFrame], check: Check | None = None, tables: int = 1,
             ordered: bool = False, narrow: bool = False) -> None:
    """Make ``apply(table, **params)`` (or two tables) usable as a chain step."""
    if name in ALIASES:
        raise ValueError(f"{name} is another name of {ALIASES[name]}")
    _OPERATORS[name] = Operator(name, apply, check, tables, ordered, narrow)


def lookup(name: str) -> Operator:
    name = ALIASES.get(name, name)
    if name not in _OPERATORS:
        raise ValueError(f"unknown operator {name!r}; known are {sorted(_OPERATORS)}")
    return _OPERATORS[name]


def available() -> dict[str, Operator]:
    return dict(_OPERATORS)


register("filter", filter_rows, _check_filter, narrow=True)
register("groupby", group_rows, _check_groupby)
register("sort", sort_rows, _check_sort)
register("pivot", pivot_rows, _check_pivot)
register("unpivot", unpivot_columns, _check_unpivot, narrow=True)
register("explode", _explode, _check_explode, narrow=True)
register("wide_to_long", wide_to_long, _check_wide_to_long, narrow=True)
register("join", _join, _check_join, tables=2)
register("union", _union, _check_union, tables=2)
register("transpose", transpose_table, _check_transpose)
register("dropna", drop_missing, _check_how_and_subset("dropna", "how", ("any", "all")), narrow=True)
register("deduplicate", drop_duplicates, _check_how_and_subset("deduplicate", "keep", ("first", "last")),
         ordered=True)
register("topk", top_rows, _check_topk, ordered=True)
register("select", select_columns, _check_select, narrow=True)
register("cast", cast_column, _check_cast, narrow=True)
register("rename", _rename, _check_rename, narrow=True)

BUILT_IN = tuple(_OPERATORS)
