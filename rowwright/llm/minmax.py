"""Near copies by min-max hashing.

Each permutation of the shingle hashes gives two signature values, the least and the
greatest: half the hash evaluations of plain MinHash, the same unbiased estimate with
less variance.  Four values make a band; documents that share a band are compared on
their full shingle sets.

Documents with equal sets count once.  All documents that share bands with the same
smallest document (its star) meet in one group; any two that share a band are in the
star of the smallest document of that band.  Inside a group an inverted index counts
common shingles, and only a forest of confirmed links leaves it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..jobs.keygraph import components
from ..session import cut_lineage
from .common import Memo, map_rows, pick, small

WORDS = 5
#: Permutations; two values each, four values a band: 32 bands. A pair at 0.75 shares none with probability 5e-6.
PERMUTATIONS, PER_BAND = 64, 2
#: Shingles of all members that one group holds in memory; larger stars are cut into blocks that meet in pairs.
GROUP = 2_000_000
_random = np.random.default_rng(5)
TIMES = _random.integers(0, 2**64, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)
PLUS = _random.integers(0, 2**64, PERMUTATIONS, dtype=np.uint64)
PLACES = _random.integers(0, 2**64, WORDS + 2, dtype=np.uint64) | np.uint64(1)
SCATTER = np.uint64(0x9E3779B97F4A7C15)


def _stir(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * SCATTER
    return values ^ (values >> np.uint64(29))


class Shingler:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""

    def __init__(self):
        self.hashes = Memo(xxhash.xxh3_64_intdigest, 32 << 20)

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()  # both only know ASCII
        n = len(words)
        if not n:
            return np.empty(0, np.uint64)
        hashed = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, n)
        if n < WORDS:  # the whole sequence is the only shingle
            return _stir((hashed * PLACES[:n]).sum(keepdims=True) + PLACES[-1:] * np.uint64(n))
        mixed = sum(hashed[k:n - WORDS + 1 + k] * PLACES[k] for k in range(WORDS))
        return np.unique(_stir(mixed))


def bands(shingles: np.ndarray) -> np.ndarray:
    """Band keys of one set of shingles."""
    least = np.full(PERMUTATIONS, 2**64 - 1, np.uint64)
    most = np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(shingles), 4096):
        values = shingles[at:at + 4096] * TIMES[:, None] + PLUS[:, None]
        np.minimum(least, values.min(axis=1), out=least)
        np.maximum(most, values.max(axis=1), out=most)
    keys = np.zeros(PERMUTATIONS // PER_BAND, np.uint64)
    for k in range(PER_BAND):
        keys = _stir(_stir(keys * SCATTER + least[k::PER_BAND]) * SCATTER + most[k::PER_BAND])
    return _stir(keys + np.arange(len(keys), dtype=np.uint64) * SCATTER).view(np.int64)


def signatures(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, set_key, bands)``; sets without shingles have no bands. One narrow pass."""
    def run(rows):
        shingle = Shingler()
        for i, t in rows:
            found = shingle(t)
            keys = bands(found).tolist() if len(found) else []
            yield i, len(found), hashlib.blake2b(found.tobytes(), digest_size=16).digest(), keys

    kind = df.schema[doc_id].dataType.simpleString()
    return map_rows(pick(df, id=doc_id, text=text), run,
                    f"doc_id {kind}, n_shingles long, set_key binary, bands array<long>")


def linked(ids: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between the given sets.

    The set that shares most with all others goes first; what it links needs no comparison
    among itself.  The rest are compared with all, by counts from an inverted index.
    """
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(place, kind="stable")
    owner_of, starts = owner[order], np.searchsorted(place[order], np.arange(len(values) + 1))
    spread = np.diff(starts)
    own = np.concatenate([[0], np.cumsum(sizes)])
    mine = [place[own[i]:own[i + 1]] for i in range(len(sets))]
    root = list(range(len(sets)))
    out = []

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def compare(i: int) -> None:
        shared = mine[i][spread[mine[i]] > 1]
        if not len(shared):
            return
        reach = np.concatenate([owner_of[starts[s]:starts[s + 1]] for s in shared])
        common = np.bincount(reach, minlength=len(sets))
        for j in np.flatnonzero(100 * common >= percent * (sizes + sizes[i] - common)).tolist():
            a, b = top(i), top(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((ids[i], ids[j]))

    first = int(np.argmax([spread[m].sum() for m in mine]))
    compare(first)
    for i in range(len(sets)):
        if top(i) != top(first):
            compare(i)
    return out


def links(docs: DataFrame, classes: DataFrame, doc_id: str, text: str, percent: int, group: int) -> DataFrame:
    """``(a, b)``: confirmed links that connect what is linked; ``classes`` are rows of ``(rep, n, bands)``."""
    each = classes.select("rep", "n", F.explode("bands").alias("band"))
    stars = each.groupBy("band").agg(F.min("rep").alias("hub"), F.count("*").alias("c")).filter("c > 1").select("band", "hub")
    member = cut_lineage(each.join(cut_lineage(stars), "band").groupBy("hub", "rep").agg(F.max("n").alias("n")))
    blocks = member.groupBy("hub").agg(F.ceil(F.sum("n") / group).cast("int").alias("blocks"))
    placed = member.join(cut_lineage(blocks), "hub")
    mine = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(
        F.col("hub"), F.least(mine, j).alias("i"), F.greatest(mine, j).alias("j")))
    to = placed.select("rep", F.explode(others).alias("group")).groupBy("rep").agg(F.collect_list("group").alias("groups"))
    texts = pick(docs, rep=doc_id, text=text)
    kind = docs.schema[doc_id].dataType.simpleString()

    def send(rows):
        shingle = Shingler()
        for rep, t, groups in rows:
            found = shingle(t)
            for g in groups if len(found) else ():
                yield g["hub"], g["i"], g["j"], rep, found.tobytes()

    sent = map_rows(texts.join(to, "rep").select("rep", "text", "groups"), send, f"hub {kind}, i int, j int, rep {kind}, shingles binary", 500)
    by = ["hub", "i", "j"]

    def meet(rows):
        key, ids, sets = None, [], []
        for *own, rep, data in rows:
            if own != key:
                if len(ids) > 1:
                    yield from linked(ids, sets, percent)
                key, ids, sets = own, [], []
            ids.append(rep)
            sets.append(np.frombuffer(data, np.uint64))
        if len(ids) > 1:
            yield from linked(ids, sets, percent)

    return map_rows(sent.repartition(*by).sortWithinPartitions(*by), meet, f"a {kind}, b {kind}")


def near_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 75, group: int = GROUP) -> DataFrame:
    """One row per document: ``(doc_id, n_shingles, component_id, kept)``.

    Documents are linked when ``100 * common >= percent * union`` of their shingle sets; a
    component bears its smallest id, which is the document that stays.  Texts without words
    are linked with nothing, nor are rows without id; both stay.  Rows with one id are one document.

    Shuffled are 32 band keys per distinct set, each text once, and the sets of documents that
    share a band, once per star.
    """
    found = cut_lineage(signatures(df, doc_id, text))
    real = found.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = cut_lineage(real.groupBy("set_key").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")))
    edges = cut_lineage(links(df, classes, doc_id, text, percent, group))
    whole = components(edges).select(F.col("node").alias("rep"), "component")
    same = cut_lineage(classes.select("set_key", "rep").join(whole, "rep", "left").select(
        "set_key", F.coalesce("component", "rep").alias("component")))
    joined = found.select("doc_id", "n_shingles", "set_key").join(same, "set_key", "left")
    mine = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    done = joined.select("doc_id", "n_shingles", mine.alias("component_id"))
    return done.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``df``, all columns, without the documents that another one stands for.

    Null and empty texts and rows without id stay; repeated rows stay or go together; an empty table stays empty; extra columns
    keep their names.  Texts stay where they are while the ids to drop measure as small.
    """
    gone = near_copies(df, doc_id, text, **options).filter("NOT kept").select(F.col("doc_id").alias("__id")).distinct()
    gone = small(cut_lineage(gone))
    return df.join(gone, df[doc_id] == gone["__id"], "left_anti")
