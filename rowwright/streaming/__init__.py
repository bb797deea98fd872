"""Chains over streaming tables.

Chains are defined on complete tables.  Steps that work row by row need
no more than the row at hand, so they run unchanged on a stream.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..plans.chain import ChainError, run_chain
from ..plans.registry import lookup


def stream_chain(stream: DataFrame, chain: Sequence[dict]) -> DataFrame:
    """Apply narrow steps to a streaming table; any other step is an error.

    Choices that would need a look at all data must be made by the caller: ``explode`` needs
    a ``mode`` other than "auto", ``wide_to_long`` needs ``check_unique=False``.
    """
    steps = []
    for number, step in enumerate(chain, start=1):
        operator = lookup(step.get("op", ""))
        params = dict(step.get("params") or {})
        if not operator.narrow:
            raise ChainError(f"step {number} ({operator.name}) needs the whole table")
        if operator.name == "explode" and params.get("mode", "auto") == "auto" and not params.get("split_comma"):
            raise ChainError(f"step {number} (explode) needs a mode on a stream")
        if operator.name == "wide_to_long" and params.get("check_unique", True):
            raise ChainError(f"step {number} (wide_to_long) needs check_unique=False on a stream")
        steps.append({**step, "params": params})
    return run_chain(stream, steps).result
