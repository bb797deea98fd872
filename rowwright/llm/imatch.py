"""I-Match fingerprints over randomised lexicon subsets.

The lexicon holds the terms whose inverse document frequency lies in a band.  A document's distinct terms
of a lexicon subset are sorted and hashed together.  There are six nested subsets, each with a quarter of the terms of the one before, each
hashed whole; each is cut into parts, which are smaller subsets.  Documents of any length have parts in which they hold
only one or two terms: those tell how like two documents are, since a hash over many terms says nothing after an edit.
Short documents use a thousand fine parts of the lexicon, so hardly any two of their terms share one.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import Counter

import numpy as np
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, map_rows, pick

#: Share of documents that hold a term of the lexicon: at least and at most. The lower bound also bounds the
#: lexicon: at most (mean distinct terms per document) / RAREST terms, whatever the number of documents.
RAREST, COMMONEST = 0.001, 0.1
LEVELS, PARTS, FEW = 6, 32, 2
#: Parts for documents of so few terms of the lexicon, and the number of the first of them.
FINE, SHORT, FIRST_FINE = 1024, 48, 256
#: A fingerprint: a bit for each dense part, a whole hash for each level, whether the fine parts are there, then eight bytes a part.
BITS, WHOLE = LEVELS * PARTS // 8, 6
HEAD = BITS + LEVELS * WHOLE + 1
#: Distinct terms a task counts before it hands them on.
HELD = 400_000
SCATTER = np.uint64(0x9E3779B97F4A7C15)


def terms(text: str) -> set[bytes]:
    """Distinct words, A-Z in lower case."""
    return set(text.encode().lower().split())


def lexicon(df: DataFrame, text: str) -> np.ndarray:
    """Sorted 64-bit hashes of the terms in the band, over all documents.

    Each task counts its documents' terms and sends one count per term; the terms that remain are
    bounded in number (see ``RAREST``) and come to the driver as hashes.
    """
    def run(rows):
        counts: Counter = Counter()
        n = 0
        for (t,) in rows:
            n += 1
            counts.update(terms(t or ""))
            if len(counts) > HELD:
                yield from ((xxhash.xxh3_64_intdigest(w) - 2**63, c) for w, c in counts.items())
                counts.clear()
        yield from ((xxhash.xxh3_64_intdigest(w) - 2**63, c) for w, c in counts.items())
        yield None, n

    found = map_rows(pick(df, text=text), run, "term long, n long", 20_000).groupBy("term").agg(F.sum("n").alias("n"))
    documents = df.count()
    low, high = RAREST * documents, max(1.0, COMMONEST * documents)
    kept = found.filter(F.col("term").isNotNull() & (F.col("n") >= low) & (F.col("n") <= high)).select("term")
    return np.sort(kept.toPandas()["term"].to_numpy(np.int64))


def _stir(values: np.ndarray) -> np.ndarray:
    values = values * SCATTER
    values = (values ^ (values >> np.uint64(31))) * SCATTER
    return values ^ (values >> np.uint64(29))


def part_hashes(terms_of: np.ndarray, parts: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sorted term hashes and their parts: the parts in use, how many terms each holds, and a record for each, the number
    of the part (two bytes) and a hash of its terms in order (six)."""
    order = np.argsort(parts, kind="stable")  # within a part the terms stay sorted
    placed = parts[order]
    starts = np.flatnonzero(np.append(True, placed[1:] != placed[:-1]))
    used, counts = placed[starts], np.diff(np.append(starts, len(placed)))
    rank = (np.arange(len(placed)) - np.repeat(starts, counts)).astype(np.uint64)
    mixed = _stir(terms_of[order].view(np.uint64) + _stir(rank + np.uint64(1)))
    number = (used + start).astype(np.uint64)
    hashed = _stir(np.add.reduceat(mixed, starts) + _stir(number))
    return used, counts, number << np.uint64(48) | hashed >> np.uint64(16)


def fingerprint(hashes: np.ndarray) -> bytes:
    """Of sorted distinct term hashes; see ``BITS`` and ``HEAD`` for the layout."""
    drawn = _stir(hashes.view(np.uint64))
    low = drawn >> np.uint64(20)
    depth = np.ones(len(hashes), np.int64)  # levels that hold the term
    for level in range(1, LEVELS):
        depth += low & np.uint64(4**level - 1) == 0
    whole = []
    for level in range(int(depth.max(initial=0))):
        whole.append(xxhash.xxh3_64_digest(hashes[depth > level].tobytes(), seed=level)[:WHOLE])
    # every term once a level, all parts of all levels in one step
    at = np.repeat(np.arange(len(hashes)), depth)
    level = np.arange(len(at)) - np.repeat(depth.cumsum() - depth, depth)
    parts = level * PARTS + (drawn[at] & np.uint64(PARTS - 1)).astype(np.int64)
    fine = 0 < len(hashes) <= SHORT
    if fine:
        at = np.concatenate([at, np.arange(len(hashes))])
        parts = np.concatenate([parts, FIRST_FINE + ((drawn >> np.uint64(40)) & np.uint64(FINE - 1)).astype(np.int64)])
    bits, found = np.zeros(LEVELS * PARTS, bool), np.empty(0, np.uint64)
    if len(at):
        used, counts, found = part_hashes(hashes[at], parts, 0)
        kept = (counts <= FEW) | (used >= FIRST_FINE)
        bits[used[~kept]] = True
        found = found[kept]
    dense = np.packbits(bits, bitorder="little").tobytes()[::-1]
    return b"".join([dense, *whole, bytes(WHOLE * (LEVELS - len(whole))), bytes([fine]), found.tobytes()])


def _records(made: bytes, dense: int, fine: bool) -> dict[int, int]:
    """The parts to compare and their hashes: the fine ones, or those that are dense in neither document."""
    found = np.frombuffer(made, np.uint64, offset=HEAD).tolist()
    parts = {r >> 48: r for r in found}
    return {p: r for p, r in parts.items() if (p >= FIRST_FINE) == fine and not (dense >> p & 1 and not fine)}


def likeness(one: bytes, two: bytes) -> float:
    """Share of equal parts among those that one of two documents has and neither is dense in; the fine parts
    if both have them.  Equal fingerprints are 1.  Without a part to compare, the share of equal whole levels."""
    if one == two:
        return 1.0
    dense = int.from_bytes(one[:BITS], "big") | int.from_bytes(two[:BITS], "big")
    fine = bool(one[HEAD - 1] and two[HEAD - 1])
    a, b = _records(one, dense, fine), _records(two, dense, fine)
    parts = a.keys() | b.keys()
    if parts:
        return sum(a.get(p) == b.get(p) for p in parts) / len(parts)
    wholes = [(x[k:k + WHOLE]) for x in (one, two) for k in range(BITS, HEAD - 1, WHOLE)]
    pairs = [(x, y) for x, y in zip(wholes[:LEVELS], wholes[LEVELS:], strict=True) if any(x) or any(y)]
    return sum(x == y for x, y in pairs) / len(pairs) if pairs else 0.0


class Printer:
    """Fingerprints of texts by a given lexicon.

    A text without a term of it has the digest of the text in four parts of its own, so its fingerprint tells it apart.
    """

    def __init__(self, words: np.ndarray):
        self.words = words
        self.known = Memo(self._known, 72 << 20)

    def _known(self, word: bytes) -> int | bool:
        hashed = xxhash.xxh3_64_intdigest(word) - 2**63
        at = int(np.searchsorted(self.words, hashed))
        return hashed if at < len(self.words) and self.words[at] == hashed else False

    def __call__(self, text: str) -> bytes:
        found = [h for h in map(self.known.__getitem__, terms(text)) if h is not False]
        hashes = np.sort(np.array(found, np.int64))
        made = fingerprint(hashes)
        if len(hashes):
            return made
        digest = hashlib.sha256(text.encode()).digest()
        own = [(FIRST_FINE + FINE + k) << 48 | int.from_bytes(digest[6 * k:6 * k + 6], "big") for k in range(4)]
        return made[:HEAD - 1] + b"\x01" + np.array(own, np.uint64).tobytes()


def edited(text: str, after: str) -> str:
    """The last quarter of the text replaced by as much of the start of the other."""
    quarter = len(text) // 4
    return text[:len(text) - quarter] + after[:quarter]


def neighbours(df: DataFrame, doc_id: str, text: str, function, schema: str) -> DataFrame:
    """``function`` over pairs ``(doc_id, text, next_text)`` in ascending order of ids (null first, equal
    ids by digest of the text); after the last comes the first.

    Ids are cut into ranges, a few per task.  Each text is shuffled once, compressed, to its range; the first of a
    range also goes to the end of the range before.  Only range borders come to the driver.
    """
    spark = df.sparkSession
    width = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = pick(df, id=doc_id)
    kind = df.schema[doc_id].dataType.simpleString()
    # borders from the ids with the least hashes, a bounded sample that is the same in every run
    some = ids.filter("id IS NOT NULL").orderBy(F.xxhash64("id"), "id").limit(20 * width).collect()
    sampled = sorted(r.id for r in some)
    cuts = sorted({sampled[len(sampled) * i // width] for i in range(1, width)}) if sampled else []

    def place_of(i) -> int:
        return 0 if i is None else bisect_right(cuts, i)

    def least(source):
        held: dict[int, tuple] = {}
        for (i,) in source:
            at = place_of(i)
            if at not in held or i is None or (held[at][0] is not None and i < held[at][0]):
                held[at] = (i,)
        yield from ((at, i, i is None) for at, (i,) in held.items())

    firsts = map_rows(ids, least, f"place int, id {kind}, none boolean").groupBy("place").agg(
        F.min("id").alias("first"), F.bool_or("none").alias("none"))
    rows = sorted((r.place, None if r.none else r.first) for r in firsts.collect())
    first = dict(rows)
    before = {p: rows[k - 1][0] for k, (p, _) in enumerate(rows)}

    def send(source):
        pack = zstandard.ZstdCompressor(level=3)
        for i, t in source:
            data = (t or "").encode()
            at = place_of(i)
            row = i, hashlib.sha256(data).digest(), pack.compress(data)
            yield at, 0, *row
            if i == first[at]:
                yield before[at], 1, *row

    def meet(source):
        unpack = zstandard.ZstdDecompressor()

        def pairs():
            held = None
            for at, tail, i, _, packed in source:
                if held and held[0] == at and not held[1]:
                    t = unpack.decompress(packed).decode()
                    yield held[2], held[3], t
                    held = at, tail, i, t
                elif not tail:
                    held = at, tail, i, unpack.decompress(packed).decode()
        return function(pairs())

    sent = map_rows(pick(df, id=doc_id, text=text), send, f"place int, tail int, id {kind}, tie binary, packed binary", 500)
    return map_rows(sent.repartition("place").sortWithinPartitions("place", "tail", "id", "tie"), meet, schema, 500)


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``.

    Null texts count as empty; a text without a term of the lexicon has a digest of itself
    in its parts and is like only to its equals.  Ids of any ordered type, null or repeated, and extra columns are allowed.  Equal texts have equal fingerprints.  Fingerprints are in hex.
    """
    words = df.sparkSession.sparkContext.broadcast(lexicon(df, text))
    kind = df.schema[doc_id].dataType.simpleString()

    def run(pairs):
        printer = Printer(words.value)
        last = None, None
        for i, t, after in pairs:
            changed = edited(t, after)
            mine = last[1] if last[0] == t else printer(t)
            other, following = printer(changed), printer(after)
            last = after, following
            digest = hashlib.sha256(changed.encode()).hexdigest()
            yield i, len(t), digest, mine.hex(), other.hex(), likeness(mine, other), likeness(mine, following)

    return neighbours(df, doc_id, text, run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, "
                      "edited_fingerprint string, near_edited double, near_next double")
