"""Passing whole texts through Python in Arrow batches.

Texts come in as strings or UTF-8 bytes, one record batch at a time, so a task holds
one batch (bounded by ``spark.sql.execution.arrow.maxBytesPerBatch``), never a partition.
A null text counts as empty everywhere; each row stands for itself, repeated or null
ids included.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from sys import getsizeof

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of output per record batch, and of input that are Python objects at a time.
OUT_ROWS, IN_ROWS = 2_000, 256


class Memo(dict):
    """A function's results, in about ``limit`` bytes; of two generations the older is forgotten."""

    def __init__(self, function: Callable, limit: int = 24 << 20):
        self.function, self.limit, self.older, self.size = function, limit, {}, 0

    def __missing__(self, key):
        if self.size >= self.limit // 2:
            self.older, self.size = dict(self), 0
            self.clear()
        value = self.older.get(key)
        if value is None:
            value = self.function(key)
        self.size += getsizeof(key) + getsizeof(value) + 100  # an entry of a dictionary
        self[key] = value
        return value


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under names of our own: ``pick(df, id="doc_id")``."""
    return df.select(*[df[name].alias(alias) for alias, name in columns.items()])


def as_batches(rows: Iterable[tuple], schema: pa.Schema, size: int = OUT_ROWS) -> Iterator[pa.RecordBatch]:
    """Tuples in the order of the schema as record batches."""
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield batch()
            held = []
    if held:
        yield batch()


def map_rows(df: DataFrame, function: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str,
             size: int = OUT_ROWS) -> DataFrame:
    """``function`` turns the rows of a partition, as tuples, into tuples of ``schema``."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        def rows():
            for batch in batches:
                for at in range(0, batch.num_rows, IN_ROWS):  # whole texts become Python objects a few at a time
                    yield from zip(*[c.to_pylist() for c in batch.slice(at, IN_ROWS).columns], strict=True)
        return as_batches(function(rows()), arrow, size)

    return df.mapInArrow(run, schema)


#: Rows and bytes of a stored table that may go to every executor.
SMALL_ROWS, SMALL_BYTES = 1_000_000, 64 << 20


def small(stored: DataFrame) -> DataFrame:
    """A stored table, marked for broadcast if it measures as small; otherwise as it is."""
    size = F.sum(sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in stored.columns), F.lit(16)))
    rows, width = stored.agg(F.count("*"), F.coalesce(size, F.lit(0))).first()
    return F.broadcast(stored) if rows <= SMALL_ROWS and width <= SMALL_BYTES else stored


def remainder(doc_id: str, by: int):
    """crc32 of the id as text, modulo ``by``; the split into training and held-out rows."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % F.lit(by)
