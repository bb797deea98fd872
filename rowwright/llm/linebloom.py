"""Lines that many documents share, found with two Bloom filters.

The first filter holds the hashes of lines seen once, the second those seen twice: a line that
finds all its bits in the first goes into the second.  Every task fills a pair of filters; pairs
are merged by the same rule, bit by bit: what both hold once is held twice.  So every
line of two documents is in the second filter, along with a few lines of one.  Only lines
found there are suspects and shuffled, as 16-byte digests, to be counted exactly and to choose the document
that keeps them.  Texts are joined with the lines they lose, never with each other.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import map_rows, pick

SPACES = " \t\n\x0b\x0c\r"
#: Code points of the shortest key, and documents that make a key common.
LEAST, COMMON = 20, 3
#: Filter bits a key, probes a key, and the bits of one filter at least and at most (powers of two; 32 MB).
#: Above 2^28 / 8 = 33 million keys more lines of one document become suspects; results stay the same.
PER_KEY, PROBES, FEWEST_BITS, MOST_BITS = 8, 4, 13, 28
DIGEST = 16
#: A filter travels in pieces of so many bytes.
PIECE = 1 << 16
#: Common keys met by more suspects than this part of them are joined by broadcast, so at most this many.
HOT_KEYS = 4096


def key(line: str) -> bytes:
    """The line without white space at its ends, A-Z in lower case."""
    return line.strip(SPACES).encode().lower()


def digests(text: str | None, least: int = LEAST) -> list[bytes]:
    """Digests of the lines of a text, in order; empty for lines too short to count."""
    out = []
    for line in (text or "").split("\n"):
        bare = line.strip(SPACES)
        out.append(hashlib.blake2b(bare.encode().lower(), digest_size=DIGEST).digest() if len(bare) >= least else b"")
    return out


def probes(keys: bytes, bits: int) -> np.ndarray:
    """The places of each digest in a filter of 2^bits: its four quarters are independent."""
    return np.frombuffer(keys, "<u4").reshape(-1, PROBES) & np.uint32((1 << bits) - 1)


class Filters:
    """A filter of what was seen and one of what was seen again, in bits of bytes."""

    def __init__(self, bits: int):
        self.bits = bits
        self.once, self.twice = np.zeros(1 << bits - 3, np.uint8), np.zeros(1 << bits - 3, np.uint8)

    def add(self, keys: bytes) -> None:
        """Different digests of one document.  A digest whose bits are all set was, or seems, seen before."""
        at = probes(keys, self.bits)
        again = at[self._in(self.once, at)]
        for filled, places in ((self.twice, again.ravel()), (self.once, at.ravel())):
            np.bitwise_or.at(filled, places >> 3, np.left_shift(np.uint8(1), (places & 7).astype(np.uint8)))

    def repeated(self, keys: bytes) -> np.ndarray:
        return self._in(self.twice, probes(keys, self.bits))

    @staticmethod
    def _in(filled: np.ndarray, at: np.ndarray) -> np.ndarray:
        return ((filled[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def merge(once: np.ndarray, twice: np.ndarray, more_once: np.ndarray, more_twice: np.ndarray) -> None:
    """Adds a pair of filters to the first pair."""
    twice |= more_twice | (once & more_once)
    once |= more_once


def keys_of(df: DataFrame, doc_id: str, text: str, least: int) -> DataFrame:
    """``(doc_id, text_md5, keys)``: the different digests of each document, one after the other."""
    kind = df.schema[doc_id].dataType.simpleString()

    def run(rows):
        for i, t in rows:
            t = t or ""
            yield i, hashlib.md5(t.encode()).digest(), b"".join(sorted(set(digests(t, least)) - {b""}))

    return map_rows(pick(df, id=doc_id, text=text), run, f"doc_id {kind}, text_md5 binary, keys binary")


def repeated_filter(found: DataFrame, bits: int) -> np.ndarray:
    """The filter of digests that two documents hold.  Pieces are merged in two levels, then joined (32 MB at most)."""
    def fill(rows):
        own = Filters(bits)
        for (keys,) in rows:
            if keys:
                own.add(keys)
        for at in range(0, len(own.once), PIECE):
            once = own.once[at:at + PIECE]
            if once.any():
                yield at, once.tobytes(), own.twice[at:at + PIECE].tobytes()

    def add(rows):
        key, once, twice = None, None, None
        for at, *data in rows:
            new = [np.frombuffer(d, np.uint8).copy() for d in data]
            if at != key:
                if key is not None:
                    yield key, once.tobytes(), twice.tobytes()
                key, (once, twice) = at, new
            else:
                merge(once, twice, *new)
        if key is not None:
            yield key, once.tobytes(), twice.tobytes()

    schema = "at int, once binary, twice binary"
    pieces = map_rows(found.select("keys"), fill, schema, 50)
    for level in (F.pmod(F.spark_partition_id(), F.lit(32)), F.lit(0)):  # no task merges more than a part of the tasks' pieces
        placed = pieces.withColumn("lane", level)
        pieces = map_rows(placed.repartition("at", "lane").sortWithinPartitions("at", "lane").select("at", "once", "twice"),
                          add, schema, 50)
    whole = np.zeros(1 << bits - 3, np.uint8)
    for row in pieces.select("at", "twice").toLocalIterator():
        part = np.frombuffer(row.twice, np.uint8)
        whole[row.at:row.at + len(part)] |= part
    return whole


def suspects(found: DataFrame, most_bits: int) -> DataFrame:
    """``(doc_id, text_md5, digest)`` of lines that seem to be in two documents."""
    n = found.agg(F.coalesce(F.sum(F.octet_length("keys")), F.lit(0)).alias("n")).first().n // DIGEST
    bits = min(most_bits, max(FEWEST_BITS, int(np.ceil(np.log2(max(1, n) * PER_KEY)))))
    shared = found.sparkSession.sparkContext.broadcast(repeated_filter(found, bits))

    def run(rows):
        filters = Filters(3)
        filters.bits, filters.twice = bits, shared.value
        for i, name, keys in rows:
            if keys:
                for k in np.flatnonzero(filters.repeated(keys)).tolist():
                    yield i, name, keys[k * DIGEST:k * DIGEST + DIGEST]

    kind = found.schema["doc_id"].dataType.simpleString()
    return map_rows(found, run, f"doc_id {kind}, text_md5 binary, digest binary", 20_000)


def lost_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, common: int = COMMON,
               most_bits: int = MOST_BITS) -> DataFrame:
    """``(doc_id, text_md5, gone)``: the digests that each document loses, for documents that lose some."""
    found = cut_lineage(keys_of(df, doc_id, text, least))
    some = cut_lineage(suspects(found, most_bits))
    # nulls are least: a document without id never keeps a line from one that has an id
    holders = some.groupBy("digest").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).filter(F.col("n") >= common)
    holders = cut_lineage(holders)
    total = holders.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    hot = F.col("n") > max(1000, total // HOT_KEYS)
    loses = (F.col("doc_id") < F.col("keeper")) | (F.col("doc_id").isNull() & F.col("keeper").isNotNull())
    often = some.join(F.broadcast(holders.filter(hot)), "digest").filter(loses)
    seldom = some.join(F.broadcast(holders.filter(hot).select("digest")), "digest", "left_anti")
    seldom = seldom.join(holders.filter(~hot), "digest").filter(loses)
    gone = often.unionByName(seldom).groupBy("doc_id", "text_md5").agg(F.collect_set("digest").alias("gone"))
    return cut_lineage(gone)


def drop_common_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, common: int = COMMON,
                      most_bits: int = MOST_BITS) -> DataFrame:
    """One row per document: ``(doc_id, text, n_lines, n_dropped)``, the text without lines that others keep.

    A line's key is the line without white space at its ends, A-Z in lower case.  A key of at least ``least`` code
    points that ``common`` documents hold stays in the document with the largest id alone, there in all its lines.
    Null and empty texts are one empty line.  Rows count as documents each, whether or not their ids are equal; rows
    that share the largest id all keep the line; null ids are smaller than any other.  Other columns are
    ignored, whatever their names.  An empty table gives no rows.

    Texts are read twice; they are shuffled only if the lines to drop are too many for a broadcast.
    """
    gone = lost_lines(df, doc_id, text, least, common, most_bits).select(
        F.col("doc_id").alias("gone_id"), F.col("text_md5").alias("gone_md5"), "gone")
    rows = pick(df, doc_id=doc_id, text=text).withColumn("text", F.coalesce("text", F.lit("")))
    same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.unhex(F.md5(F.col("text").cast("binary"))) == F.col("gone_md5"))
    joined = rows.join(gone, same, "left").select("doc_id", "text", "gone")
    kind = df.schema[doc_id].dataType.simpleString()

    def run(rows):
        for i, t, lost in rows:
            lines = t.split("\n")
            kept = lines
            if lost:
                lost = set(lost)
                kept = [line for line, d in zip(lines, digests(t, least), strict=True) if d not in lost]
            yield i, "\n".join(kept), len(lines), len(lines) - len(kept)

    return map_rows(joined, run, f"doc_id {kind}, text string, n_lines long, n_dropped long", 200)
