"""Exact copies by content-defined chunk recipes.

A text without white space is cut where a rolling hash of the bytes before says so, and
each chunk gets an identifier.  Identifiers are verified: where two different chunks
share a hash, they are told apart by rank.  A document's recipe is the ordered list of
its identifiers, and texts are equal exactly when recipes are.  Recipes are compared
instead of texts; contents move once, each distinct chunk once per task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import map_rows, pick, small

#: Chunk sizes in bytes, and the bits of the rolling hash that are zero at a cut.
LEAST, MOST, BITS = 512, 16_384, 11
SPACES = b" \t\n\x0b\x0c\r"
GEAR = np.random.default_rng(20).integers(0, 2**32, 256, dtype=np.uint32)


def cuts(data: bytes, least: int = LEAST, most: int = MOST, bits: int = BITS) -> list[int]:
    """Where chunks end.  The rolling hash covers 32 bytes and is built by doubling its window."""
    if len(data) <= least:
        return [len(data)] if data else []
    rolling = GEAR[np.frombuffer(data, np.uint8)]
    for width in (1, 2, 4, 8, 16):
        rolling[width:] += rolling[:-width] << np.uint32(width)
    ends, start = [], 0
    for at in np.flatnonzero(rolling >> np.uint32(32 - bits) == 0) + 1:
        while at - start > most:
            start += most
            ends.append(start)
        if at - start >= least:
            start = int(at)
            ends.append(start)
    while len(data) - start > most:
        start += most
        ends.append(start)
    return ends + [len(data)] * (start < len(data))


def chunks(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def chunk_hash(chunk: bytes, size: int) -> bytes:
    return xxhash.xxh3_128_digest(chunk)[:size]


def plain(text: str | None) -> bytes:
    """The text in UTF-8 without white space; null counts as empty."""
    return (text or "").encode().translate(None, SPACES)


def recipes(df: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """``(doc_id, n_chars, text_sha256, recipe)``, hashes only; one narrow pass."""
    def run(rows):
        for i, t in rows:
            data = plain(t)
            yield i, len(t or ""), hashlib.sha256(data).hexdigest(), b"".join(chunk_hash(c, size) for c in chunks(data))

    kind = df.schema[doc_id].dataType.simpleString()
    return map_rows(pick(df, id=doc_id, text=text), run, f"doc_id {kind}, n_chars long, text_sha256 string, recipe binary")


def _contents(df: DataFrame, text: str, size: int) -> DataFrame:
    """``(text_sha256, place, hash, content)`` of every chunk."""
    def run(rows):
        for (t,) in rows:
            data = plain(t)
            name = hashlib.sha256(data).hexdigest()
            for place, chunk in enumerate(chunks(data)):
                yield name, place, chunk_hash(chunk, size), chunk

    return map_rows(pick(df, text=text), run, "text_sha256 string, place int, hash binary, content binary", 500)


def shared_hashes(df: DataFrame, text: str, size: int) -> DataFrame:
    """``(hash)`` of different chunks: the contents themselves are compared, after each task has
    dropped repetitions."""
    distinct = _contents(df, text, size).groupBy("hash", "content").agg(F.lit(1).alias("one"))
    return distinct.groupBy("hash").count().filter("count > 1").select("hash")


def verified(found: DataFrame, df: DataFrame, text: str, size: int) -> DataFrame:
    """Recipes in which chunks that share a hash have different identifiers."""
    shared = cut_lineage(shared_hashes(df, text, size))
    if shared.isEmpty():  # a 128-bit hash identifies: the contents were compared
        return found
    parts = cut_lineage(_contents(df, text, size).join(shared, "hash").distinct())
    order = Window.partitionBy("hash").orderBy("content")
    ranks = parts.select("hash", "content").distinct().withColumn("rank", F.row_number().over(order))
    marks = parts.join(ranks, ["hash", "content"]).groupBy("text_sha256").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "rank"))),
                                 lambda x: F.concat_ws("/", x.place, x.rank)), ",").alias("marks"))
    exact = found.join(marks, "text_sha256", "left")
    mark = F.concat(F.lit("|"), F.coalesce("marks", F.lit(""))).cast("binary")
    return exact.withColumn("recipe", F.concat("recipe", mark)).drop("marks")


def exact_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text", hash_bytes: int = 16) -> DataFrame:
    """One row per document: ``(doc_id, keep_id, group_size, kept, text_sha256, n_chars)``.

    Texts are equal when they are after white space is deleted; of equal texts the one with
    the most code points stays, then the smallest id (null last), then one of equal rows.
    Null and empty texts are equal to each other.

    Groups are counted before they are shuffled; the join back meets one row per group, so
    a group of any size is split by adaptive execution.
    """
    found = verified(recipes(df, doc_id, text, hash_bytes), df, text, hash_bytes)
    found = cut_lineage(found.withColumn("row", F.monotonically_increasing_id()))
    best = F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    groups = found.groupBy("recipe").agg(F.count("*").alias("group_size"), best.alias("best"))
    groups = cut_lineage(groups.filter("group_size > 1"))
    joined = found.join(groups, "recipe", "left")
    alone = F.col("group_size").isNull()
    return joined.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("best.row"))).alias("kept"), "text_sha256", "n_chars")


def drop_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, that stay; of wholly equal ids and texts the one whose row has the least hash.

    Texts stay where they are while ids and digests of the rows to drop measure as small; otherwise they are joined.  Only rows of which an equal twin stays are gathered, after each task has kept one.
    Null and empty texts are equal to each other; an empty table stays empty; extra columns keep their names.
    """
    each = exact_copies(df, doc_id, text).groupBy("doc_id", "text_sha256", "n_chars").agg(
        F.bool_or("kept").alias("stays"), F.count("*").alias("twins"))
    found = cut_lineage(each.filter("NOT stays OR twins > 1").select(
        F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"), F.col("n_chars").alias("__n"), "stays"))
    bare = F.translate(F.coalesce(df[text], F.lit("")), SPACES.decode(), "")
    place = df.columns.index(doc_id)
    own = [f"c{i}" for i in range(len(df.columns))]  # no name of the caller's can clash
    named = df.select(*[df[c].alias(o) for c, o in zip(df.columns, own, strict=True)], F.sha2(bare.cast("binary"), 256).alias("__own"),
                      F.char_length(F.coalesce(df[text], F.lit(""))).cast("long").alias("__own_n"))
    same = F.col(f"c{place}").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__sha")) & (F.col("__own_n") == F.col("__n"))
    left = named.join(small(found.drop("stays")), same, "left_anti").select(*own)
    twins = found.filter("stays")
    if not twins.isEmpty():
        whole = F.struct(*own)
        one = named.join(twins.drop("stays"), same, "left_semi").groupBy(f"c{place}", "__own", "__own_n").agg(
            F.min_by(whole, F.xxhash64(*own)).alias("whole"))
        left = left.unionByName(one.select("whole.*"))
    return left.toDF(*df.columns)
