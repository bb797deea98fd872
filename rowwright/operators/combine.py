"""Operators over two tables: join and union."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import col, is_binary_float, kind_of, nan_as_null, reject_ambiguous, require_columns
from ..functions.text import to_text
from .ranges import bounds, range_join

JOIN_KINDS = ("inner", "left", "right", "outer", "cross")
HOT_ROWS = 1000  # keys with fewer rows are never worth a join of their own
# largest measured side that is sent to every executor
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 64 << 20


def join_tables(left: DataFrame, right: DataFrame, left_on: str | None = None, right_on: str | None = None,
                how: str = "inner", suffixes=("_x", "_y"), on: str | None = None, match_nulls: bool = True,
                hot_keys: str = "auto", names: tuple[str, str] = ("left", "right")) -> DataFrame:
    """Join on one key per side, on a shared column, or on a condition.

    Missing keys match each other unless ``match_nulls=False``.  Keys of different
    kinds are compared, and returned, as text.  Keys of equal name give one column;
    other shared names get the suffixes.  ``on`` may be a shared column name or a
    condition over ``names``, such as ``left.k = right.k AND left.t >= right.t``.

    ``hot_keys`` chooses a plan, never a result.  ``"adaptive"`` leaves hot keys to adaptive
    execution, which can split either side of an inner join, but not both sides of an
    outer join.  ``"split"`` joins keys with more rows than a shuffle partition holds on
    average (and more than ``HOT_ROWS``) apart; a sketch of both sides' keys finds them, and the rows
    of those it names are counted.  ``"auto"`` splits outer joins.  A side goes to all executors only if it
    measures at most ``BROADCAST_ROWS`` and ``BROADCAST_BYTES``.
    """
    if how not in JOIN_KINDS:
        raise ValueError(f"join: unknown kind {how!r}; known are {JOIN_KINDS}")
    if isinstance(on, str) and re.search(r"[<>=]|\sbetween\s", on, re.IGNORECASE):
        return _join_on_condition(left, right, on, how, suffixes, names)
    if how == "cross":
        return _finish(_small_side_hint(*_numbered(left, right)), left, right, None, how, suffixes)
    if on:
        left_on = right_on = on
    if not left_on or not right_on:
        raise ValueError("join: name left_on and right_on, or on")
    require_columns(left, [left_on], "join, left table")
    require_columns(right, [right_on], "join, right table")
    if kind_of(left.schema[left_on].dataType) != kind_of(right.schema[right_on].dataType):
        left = left.withColumn(left_on, to_text(col(left_on), left.schema[left_on].dataType))
        right = right.withColumn(right_on, to_text(col(right_on), right.schema[right_on].dataType))
    left, right = _without_nan(left, left_on), _without_nan(right, right_on)
    a, b = _numbered(left, right)
    keys = (f"l{left.columns.index(left_on)}", f"r{right.columns.index(right_on)}")
    if hot_keys not in ("auto", "adaptive", "split"):
        raise ValueError(f"join: unknown hot_keys {hot_keys!r}")
    if hot_keys == "split" or (hot_keys == "auto" and how != "inner"):
        joined = _join_split(a, b, keys, how, match_nulls)
    else:
        joined = a.join(b, _same(*keys, match_nulls), how)
    return _finish(joined, left, right, (left_on, right_on), how, suffixes)


def _numbered(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Positional names, so that shared and odd column names cannot clash."""
    return tuple(
        df.toDF(*[f"{mark}{i}" for i in range(len(df.columns))]) for mark, df in (("l", left), ("r", right))
    )


def _without_nan(df: DataFrame, name: str) -> DataFrame:
    """Missing keys have one mark, so that they meet each other."""
    if not is_binary_float(df.schema[name].dataType):
        return df
    return df.withColumn(name, F.when(~F.isnan(col(name)), col(name)))


def _same(left_key: str, right_key: str, match_nulls: bool) -> Column:
    a, b = F.col(left_key), F.col(right_key)
    return a.eqNullSafe(b) if match_nulls else a == b


def _finish(joined: DataFrame, left: DataFrame, right: DataFrame, keys, how: str, suffixes) -> DataFrame:
    """Give the positional columns their final names."""
    merged = keys[0] if keys and keys[0] == keys[1] else None
    shared = (set(left.columns) & set(right.columns)) - {merged}
    kept = [f"l{i}" for i in range(len(left.columns))]
    kept += [f"r{i}" for i, name in enumerate(right.columns) if name != merged]
    names = [name + suffixes[0] if name in shared else name for name in left.columns]
    names += [name + suffixes[1] if name in shared else name for name in right.columns if name != merged]
    reject_ambiguous(names, "join")
    if merged and how in ("right", "outer"):
        at, other = f"l{left.columns.index(merged)}", F.col(f"r{right.columns.index(merged)}")
        joined = joined.withColumn(at, other if how == "right" else F.coalesce(F.col(at), other))
    return joined.select(*kept).toDF(*names)


def _join_on_condition(left: DataFrame, right: DataFrame, condition: str, how: str, suffixes, names) -> DataFrame:
    """Equalities in the condition become hash or merge keys, the rest filters matches.  Without any, two
    comparisons that bound a pair from both sides join by buckets (``ranges``); one alone is a nested loop."""
    a, b = left.alias(names[0]), right.alias(names[1])
    ends = bounds(a, b, condition, names)
    if ends and not any(c.startswith("__") for c in left.columns + right.columns):
        return _finish(range_join(a, b, condition, how, names, ends), left, right, None, how, suffixes)
    joined = a.join(b, F.expr(condition), "inner" if how == "cross" else how)
    numbered = joined.select(
        *[F.col(f"{names[0]}.`{c}`").alias(f"l{i}") for i, c in enumerate(left.columns)],
        *[F.col(f"{names[1]}.`{c}`").alias(f"r{i}") for i, c in enumerate(right.columns)],
    )
    return _finish(numbered, left, right, None, how, suffixes)


def _is_small(df: DataFrame) -> bool:
    """Measured, not guessed: row count and text size, looking at no more rows than the limit."""
    size = F.sum(F.octet_length(F.to_json(F.struct("*"))))
    rows, width = df.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)), F.coalesce(size, F.lit(0))).first()
    return rows <= BROADCAST_ROWS and width <= BROADCAST_BYTES


def _small_side_hint(a: DataFrame, b: DataFrame) -> DataFrame:
    """The product a caller asked for; a side measured as small goes to all executors."""
    if _is_small(b):
        return a.crossJoin(F.broadcast(b))
    if _is_small(a):
        return F.broadcast(a).crossJoin(b)
    return a.crossJoin(b)


# -- hot keys ----------------------------------------------------------------------
def _hot_counts(a: DataFrame, b: DataFrame, keys: tuple[str, str]) -> tuple[dict, dict]:
    """Keys above the mean load of a shuffle partition on either side, with ``(rows, bytes)`` of each side that has them.

    A sketch of frequent items (a hash of the key) over both sides, in one job, names candidates: it tracks enough
    items that a key above the mean load of a partition cannot be missing.  Only rows of candidates are counted, in a second.
    """
    width = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = [df.select(F.xxhash64(key).alias("hash"), F.lit(side).alias("side")) for side, (df, key) in enumerate(zip((a, b), keys, strict=True))]
    sketch = F.expr(f"approx_top_k(hash, {2 * width}, {max(64, 16 * width)})")
    rows = hashed[0].unionAll(hashed[1]).groupBy("side").agg(sketch.alias("top"), F.count("*").alias("n")).collect()
    bounds_of = {r.side: max(HOT_ROWS, r.n / width) for r in rows}
    candidates = {t["item"] for r in rows for t in r.top if t["count"] > 0.7 * bounds_of[r.side]}
    if not candidates:
        return {}, {}
    some = F.col("hash").isin(*candidates)
    parts = []
    for side, (df, key) in enumerate(zip((a, b), keys, strict=True)):
        size = F.octet_length(F.to_json(F.struct("*")))
        parts.append(df.withColumn("hash", F.xxhash64(key)).filter(some).drop("hash").groupBy(F.col(key).alias("key")).agg(
            F.count("*").alias("n"), F.sum(size).alias("bytes")).select(F.lit(side).alias("side"), F.struct("key").alias(f"key{side}"), "n", "bytes"))
    found = parts[0].unionByName(parts[1], allowMissingColumns=True).collect()
    counts: tuple[dict, dict] = ({}, {})
    for r in found:
        counts[r.side][(r.key0 if r.side == 0 else r.key1).key] = (r.n, r.bytes)
    hot = {k for side in (0, 1) for k, (n, _) in counts[side].items() if n > bounds_of.get(side, 0)}
    return tuple({k: v for k, v in c.items() if k in hot} for c in counts)


def _is_one_of(key: str, values: list, dtype: T.DataType) -> Column:
    listed = [F.lit(v).cast(dtype) for v in values if v is not None]
    hit = F.col(key).isin(*listed) if listed else F.lit(False)
    hit = F.coalesce(hit, F.lit(False))
    return hit | F.col(key).isNull() if None in values else hit


def _fits(counts: dict, keys: list) -> bool:
    """Whether the counted rows of some keys may go to every executor."""
    rows, size = (sum(counts[k][i] or 0 for k in keys) for i in (0, 1))
    return rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def _join_split(a: DataFrame, b: DataFrame, keys: tuple[str, str], how: str, match_nulls: bool) -> DataFrame:
    """Join hot keys apart from the rest; together the pieces are the plain join.

    A hot key on both sides has no unmatched rows, so an inner join serves it: by
    broadcast when the measured side is small, else by shuffle, where adaptive
    execution may split either side.  A hot key on one side only needs no join.
    """
    types = (a.schema[keys[0]].dataType, b.schema[keys[1]].dataType)
    count_a, count_b = _hot_counts(a, b, keys)
    values = list(dict.fromkeys([*count_a, *count_b]))
    if not values:
        return a.join(b, _same(*keys, match_nulls), how)
    hot_a, hot_b = _is_one_of(keys[0], values, types[0]), _is_one_of(keys[1], values, types[1])
    both = [v for v in values if v in count_a and v in count_b and (match_nulls or v is not None)]
    pieces = [a.filter(~hot_a).join(b.filter(~hot_b), _same(*keys, match_nulls), how)]
    if both:
        one = a.filter(_is_one_of(keys[0], both, types[0]))
        two = b.filter(_is_one_of(keys[1], both, types[1]))
        if _fits(count_b, both):
            two = F.broadcast(two)
        elif _fits(count_a, both):
            one = F.broadcast(one)
        pieces.append(one.join(two, _same(*keys, match_nulls)))
    alone_a = [v for v in values if v in count_a and v not in both]
    alone_b = [v for v in values if v in count_b and v not in both]
    if alone_a and how in ("left", "outer"):
        kept = a.filter(_is_one_of(keys[0], alone_a, types[0]))
        pieces.append(kept.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in b.schema.fields]))
    if alone_b and how in ("right", "outer"):
        kept = b.filter(_is_one_of(keys[1], alone_b, types[1]))
        pieces.append(kept.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in a.schema.fields], "*"))
    result = pieces[0]
    for piece in pieces[1:]:
        result = result.unionAll(piece)
    return result


# -- union -------------------------------------------------------------------------
def union_tables(left: DataFrame, right: DataFrame, how: str = "all") -> DataFrame:
    """Rows of both tables, columns matched by name, absent ones null."""
    for df in (left, right):
        reject_ambiguous(df.columns, "union")
    shared = [c for c in left.columns if c in set(right.columns)]
    wanted = {c: _common_type(left.schema[c].dataType, right.schema[c].dataType) for c in shared}
    both = _retyped(left, wanted).unionByName(_retyped(right, wanted), allowMissingColumns=True)
    return nan_as_null(both).dropDuplicates() if how == "distinct" else both


def _common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """Numbers widen; anything else that differs becomes text."""
    if a == b:
        return a
    kinds = {kind_of(a), kind_of(b)}
    if kinds == {"int"}:
        return T.LongType()
    if isinstance(a, T.DecimalType) and isinstance(b, T.DecimalType):
        scale, whole = max(a.scale, b.scale), max(a.precision - a.scale, b.precision - b.scale)
        if scale + whole <= 38:
            return T.DecimalType(scale + whole, scale)
    if kinds <= {"int", "float"}:
        return T.DoubleType()
    if kinds == {"time"}:
        return T.TimestampNTZType()
    return T.StringType()


def _retyped(df: DataFrame, wanted: dict[str, T.DataType]) -> DataFrame:
    output = []
    for field in df.schema.fields:
        target = wanted.get(field.name, field.dataType)
        if target == field.dataType:
            output.append(col(field.name))
        elif isinstance(target, T.StringType):
            output.append(to_text(col(field.name), field.dataType).alias(field.name))
        else:
            output.append(col(field.name).cast(target).alias(field.name))
    return df.select(*output)
