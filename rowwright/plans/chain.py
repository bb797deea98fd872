"""Chains of operators over named tables, built into one lazy Spark plan."""

from __future__ import annotations

import copy
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.rows import sort_directions
from .registry import Operator, lookup

Directions = list[tuple[str, bool]]
KEEPS_ORDER = {"filter", "dropna", "topk", "select", "cast", "rename", "deduplicate"}


class ChainError(ValueError):
    """A step that cannot be planned, or that leaves no rows; names the step."""


@dataclass
class ChainResult:
    """Tables after the last step, in the order of their positions."""

    tables: dict[str, DataFrame]
    steps: list[dict[str, Any]] = field(default_factory=list)

    @property
    def result(self) -> DataFrame:
        return next(iter(self.tables.values()))

    def to_chain(self) -> list[dict[str, Any]]:
        """The steps that were run, under their registered names."""
        return copy.deepcopy(self.steps)

    def to_json(self) -> str:
        return json.dumps(self.steps, ensure_ascii=False, default=str)


def name_tables(tables: DataFrame | Sequence[DataFrame] | Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """``table_1``, ``table_2``, ... unless the caller brings names."""
    if isinstance(tables, Mapping):
        return dict(tables)
    if isinstance(tables, DataFrame):
        tables = [tables]
    return {f"table_{i}": df for i, df in enumerate(tables, start=1)}


def run_chain(tables: DataFrame | Sequence[DataFrame] | Mapping[str, DataFrame], chain: Sequence[dict],
              check_empty: bool | str = False) -> ChainResult:
    """Apply the steps in turn; nothing runs until the result is used.

    A step replaces its table.  A join or union removes both and appends
    ``{a}_{b}_{op}``.  A sort is remembered and decides what a later ``topk`` or
    ``deduplicate`` calls first.  ``check_empty="end"`` looks for one row of the
    result and refuses an empty one; ``check_empty=True`` counts the rows of every step while the result is computed, once,
    and names the first step that leaves none.
    """
    if check_empty not in (False, True, "end"):
        raise ValueError(f"check_empty is False, True or 'end', not {check_empty!r}")
    state = name_tables(tables)
    orders: dict[str, Directions] = {}
    done: list[dict[str, Any]] = []
    counted: list[tuple[int, str, Observation, DataFrame]] = []
    for number, step in enumerate(chain, start=1):
        name = step.get("op", "")
        try:
            operator = lookup(name)
            used = _used_tables(step, state, operator)
            params = dict(step.get("params") or {})
            if operator.ordered and "order_by" not in params and used[0] in orders:
                params["order_by"] = orders[used[0]]
            if operator.name == "join" and isinstance(params.get("on"), str):
                params.setdefault("names", tuple(used))
            output = operator.build([state[u] for u in used], params)
        except (ValueError, TypeError) as problem:
            raise ChainError(f"step {number} ({name}): {problem}") from problem
        if check_empty == "end" and number == len(chain) and output.isEmpty():
            raise ChainError(f"step {number} ({name}) leaves no rows")
        if check_empty is True:
            seen = Observation()
            output = output.observe(seen, F.count(F.lit(1)).alias("rows"))
            counted.append((number, name, seen, output))
        positions = [list(state).index(u) for u in used]
        _replace(state, orders, used, operator, params, output)
        done.append({"op": operator.name, "params": _plain(step.get("params")), "op_tables": used,
                     "table_indices": positions})
    if counted:
        given = {id(df) for df in name_tables(tables).values()}
        _refuse_empty_steps([df for df in state.values() if id(df) not in given], counted)
        return run_chain(tables, chain)  # a plan without counts, which filters can pass on their way to the scan
    return ChainResult(state, done)


def _refuse_empty_steps(tables: list[DataFrame], counted: list[tuple[int, str, Observation, DataFrame]]) -> None:
    """Compute the tables that steps have made, without keeping them, and look at the counts on the way."""
    for df in tables:
        df.write.format("noop").mode("overwrite").save()
    rows = [_counted_rows(observation) for _, _, observation, _ in counted]
    if all(rows):
        return
    for (number, name, _, output), n in zip(counted, rows, strict=True):
        if n == 0 or (n is None and output.isEmpty()):
            raise ChainError(f"step {number} ({name}) leaves no rows")


def _counted_rows(observation: Observation) -> int | None:
    """None if Spark left the step out, as it does once it knows that nothing comes of it or of what it meets."""
    try:
        return observation.get["rows"]
    except Py4JJavaError:
        return None


def _used_tables(step: dict, state: dict[str, DataFrame], operator: Operator) -> list[str]:
    used = list(step.get("op_tables") or [])
    if not used:
        used = list(state)[: operator.tables]
    unknown = [u for u in used if u not in state]
    if unknown:
        raise ValueError(f"unknown tables {unknown}; known are {list(state)}")
    return used


def _replace(state: dict[str, DataFrame], orders: dict[str, Directions], used: list[str],
             operator: Operator, params: dict, output: DataFrame) -> None:
    if operator.tables == 1:
        table = used[0]
        orders[table] = _order_after(orders.get(table, []), operator.name, params, output)
        if not orders[table]:
            del orders[table]
        state[table] = output
        return
    for table in used:
        del state[table]
        orders.pop(table, None)
    state["_".join([*used, operator.name])] = output


def _order_after(order: Directions, name: str, params: dict, output: DataFrame) -> Directions:
    """The sort keys still valid after a step; none once one of them is gone or changed."""
    if name == "sort":
        return sort_directions(params["by"], params.get("ascending", True))
    if name not in KEEPS_ORDER:
        return []
    if name == "rename":
        mapping = params.get("rename_map") or {}
        order = [(mapping.get(c, c), up) for c, up in order]
    if name == "cast" and params.get("mode") != "append" and params["column"] in {c for c, _ in order}:
        return []
    return order if {c for c, _ in order} <= set(output.columns) else []


def _plain(params: dict | None) -> dict:
    """Parameters as they can be written to JSON."""
    return {k: str(v) if isinstance(v, Column) else copy.deepcopy(v) for k, v in (params or {}).items()}
