"""Aligning the tokens of two tokenizers by diagonal run skipping.

A byte-level vocabulary (A) and a piece vocabulary (B) cut the same bytes; their tokens meet
where both end.  The ends of either side are rising lists.  At the current shift between
the two indices, slices of doubling length are compared, so a stretch in which tokens match
one to one is jumped in a few steps; where it breaks, halving finds the first difference,
the irregular group is walked through to the next common end, and the shift is that of
its end.

How often a pair of ids is linked in the corpus is counted from stored links.  Tokens that end
together cover bytes of which one is the end of the other, so the vocabularies alone
bound the number of pairs (324,300 for the public ones); counts are summed in Spark and then
fit a broadcast whatever the size of the corpus.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import regex
import sentencepiece
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import map_rows, pick

#: Characters of a stretch that is remembered (longer ones are encoded each time), and bytes of memory for them, about.
WORD, MEMORY = 64, 64 << 20
#: Every character that is white space.
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
#: Characters of texts whose new stretches are encoded together.
LOT = 300_000
#: Fixed value: how byte-level vocabularies of this kind cut a text before they merge.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the tokens of either side that end together; both rising arrays end at the same byte."""
    side_a, side_b = ends_a.astype(np.int64), ends_b.astype(np.int64)
    raw_a, raw_b, list_a, list_b = side_a.tobytes(), side_b.tobytes(), side_a.tolist(), side_b.tolist()
    n, m = len(raw_a), len(raw_b)
    i = j = 0  # in bytes of the raw arrays: eight a token
    starts, shifts, sizes = [], [], []
    while i < n and j < m:
        low, step = i, 32
        while step <= n - i and raw_a[i:i + step] == raw_b[j:j + step]:  # the diagonal, doubled while it is equal
            i += step
            j += step
            step *= 2
        while step > 8:  # and halved to the first difference
            step //= 2
            if step <= n - i and raw_a[i:i + step] == raw_b[j:j + step]:
                i += step
                j += step
        if i > low:
            starts.append(low >> 3)
            shifts.append(j - i >> 3)
            sizes.append(i - low >> 3)
        if i < n and j < m:  # an irregular group, walked through to the next common end
            x, y = list_a[i >> 3], list_b[j >> 3]
            while x != y:
                if x < y:
                    i += 8
                    x = list_a[i >> 3]
                else:
                    j += 8
                    y = list_b[j >> 3]
            starts.append(i >> 3)
            shifts.append(j - i >> 3)
            sizes.append(1)
            i += 8
            j += 8
    lengths = np.array(sizes, np.int64)
    first = lengths.cumsum() - lengths
    found = np.arange(lengths.sum()) + np.repeat(np.array(starts, np.int64) - first, lengths)
    return found, found + np.repeat(np.array(shifts, np.int64), lengths)


def byte_alphabet() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write bytes with."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Sides:
    """Both tokenizers with the bytes of their tokens, and the pairs of ids that can end together."""

    def __init__(self, byte_json: str, piece_model: bytes):
        described = json.loads(byte_json)
        named = {i: t for t, i in described["model"]["vocab"].items()}
        letters = byte_alphabet()
        self.bytes_a = [bytes(letters.get(c, 63) for c in named.get(i, "")) for i in range(max(named, default=-1) + 1)]
        self.a = self._ranked(described, named)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        self.sizes_a = np.array([len(t) for t in self.bytes_a])
        self.sizes_b = np.array([len(t) for t in self.bytes_b])
        self.width = len(self.bytes_b)
        self.pairs = self._pairs()
        # a piece with a space behind another character could join two words
        self.whole = any(" " in p.replace("▁", " ").lstrip(" ") for p in pieces)
        self.cut = regex.compile(r"(?<=\S) (?=\S)").split
        self.known: dict[str, tuple[int, int, bytes, str] | bool] = {}
        self.older: dict[str, tuple[int, int, bytes, str] | bool] = {}
        self.size = 0
        self.marked: list[str] | None = None

    def _ranked(self, described: dict, named: dict[int, str]) -> tiktoken.Encoding:
        """The byte vocabulary by its ranks.  That needs merges in the order of the ids they make."""
        special = {t["id"] for t in described.get("added_tokens", ())}
        ranks = {t: i for i, t in enumerate(self.bytes_a) if i in named and i not in special}
        vocab = described["model"]["vocab"]
        merges = (m.split(" ") if isinstance(m, str) else m for m in described["model"]["merges"])
        made = np.array([vocab["".join(m)] for m in merges])
        if len(made) and (np.diff(made) <= 0).any():
            raise ValueError("the merges of this vocabulary are not in the order of its ids")
        return tiktoken.Encoding("bytes", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

    def _pairs(self) -> np.ndarray:
        """Codes of id pairs of which one token's bytes are the end of the other's, sorted."""
        of_a, of_b = defaultdict(list), defaultdict(list)
        for i, t in enumerate(self.bytes_a):
            of_a[t].append(i)
        for j, t in enumerate(self.bytes_b):
            of_b[t].append(j)
        codes = {i * self.width + j for t, some in of_a.items() for k in range(len(t)) for j in of_b.get(t[k:], ()) for i in some}
        codes |= {i * self.width + j for t, some in of_b.items() for k in range(len(t)) for i in of_a.get(t[k:], ()) for j in some}
        return np.array(sorted(codes), np.int64)

    def encode(self, stretches: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides of each stretch; none for a stretch that B does not spell (A has every byte)."""
        spaced = [" " + s for s in stretches]
        of_b = self.b.encode(stretches, num_threads=1) if stretches else []
        of_a = list(map(self.a.encode_ordinary, spaced))
        spelled = self.bytes_b.__getitem__
        if b"".join(map(spelled, chain.from_iterable(of_b))) != "".join(spaced).encode():
            for k, (text, b) in enumerate(zip(spaced, of_b, strict=True)):
                if b"".join(map(spelled, b)) != text.encode():
                    of_a[k], of_b[k] = [], []
        return of_a, of_b

    def aligned(self, stretches: list[str]) -> list[tuple[int, int, bytes, str] | bool]:
        """Numbers of tokens, places of the linked pairs (four bytes each) and spelled groups of each stretch, or False.

        All stretches are aligned as one text: each of them ends on both sides.
        """
        of_a, of_b = self.encode(stretches)
        n_a, n_b = np.array([len(x) for x in of_a], np.int64), np.array([len(x) for x in of_b], np.int64)
        a, b = (np.fromiter(chain.from_iterable(x), np.int64, n.sum()) for x, n in ((of_a, n_a), (of_b, n_b)))
        found_a, found_b = align(self.sizes_a[a].cumsum(), self.sizes_b[b].cumsum())
        places = self.places(a[found_a], b[found_b]).astype(np.uint32).tobytes()
        texts = self.spell(a, b, found_a, found_b)
        links = 4 * np.searchsorted(found_a, n_a.cumsum())
        marks = (n_a + n_b).cumsum()
        out: list[tuple[int, int, bytes, str] | bool] = []
        link = mark = 0
        for x, y, to, end in zip(n_a.tolist(), n_b.tolist(), links.tolist(), marks.tolist(), strict=True):
            out.append((x, y, places[link:to], "".join(texts[mark:end])[:-1]) if x else False)
            link, mark = to, end
        return out

    def spell(self, a: np.ndarray, b: np.ndarray, found_a: np.ndarray, found_b: np.ndarray) -> list[str]:
        """The groups as text: every id with the mark behind it, in its place, which follows from numbers alone."""
        if self.marked is None:
            self.marked = [f"{i}{mark}" for side, mark in ((self.bytes_a, ","), (self.bytes_a, "|"), (self.bytes_b, ","), (self.bytes_b, ";"))
                           for i in range(len(side))]
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[found_a] = last_b[found_b] = 1
        group_a, group_b = last_a.cumsum() - last_a, last_b.cumsum() - last_b
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.append(0, found_b + 1)[group_a]] = a + last_a * len(self.bytes_a)
        order[np.arange(len(b)) + (found_a + 1)[group_b]] = b + 2 * len(self.bytes_a) + last_b * len(self.bytes_b)
        return list(map(self.marked.__getitem__, order.tolist()))

    def stretches(self, text: str) -> list[str]:
        """Parts that are encoded alone: both tokenizers begin a token at a lone space between two other characters."""
        if self.whole or not text:
            return [text] if text else []
        if text[0] == " " or text[-1] == " " or any(" " + c in text or c + " " in text for c in SPACES if c in text):
            return self.cut(text)
        return text.split(" ")

    def parts(self, stretches: list[str]) -> list[tuple[int, int, bytes, str] | bool]:
        """What ``aligned`` finds; stretches not met lately are aligned together."""
        known = self.known
        found = list(map(known.get, stretches))
        if None not in found:
            return found
        fresh = list(dict.fromkeys(s for s, f in zip(stretches, found, strict=True) if f is None))
        again = {s: self.older[s] for s in fresh if s in self.older}
        known.update(again)
        fresh = [s for s in fresh if s not in again] if again else fresh
        made = dict(zip(fresh, self.aligned(fresh), strict=True))
        known.update(made)
        found = list(map(known.get, stretches))
        for s in made:
            if len(s) > WORD:
                del known[s]
            else:
                self.size += 360 + 12 * len(s)
        self.size += 120 * len(again)
        if self.size > MEMORY // 2:  # of two generations the older is forgotten
            self.older, self.known, self.size = known, {}, 0
        return found

    def places(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Where id pairs stand in ``pairs``."""
        return np.searchsorted(self.pairs, a.astype(np.int64) * self.width + b)


@lru_cache(maxsize=2)
def sides(byte_json: str, piece_model: bytes) -> Sides:
    """One pair of tokenizers per worker process, however many tasks it runs."""
    return Sides(byte_json, piece_model)


def in_lots(rows: Iterable[tuple], chars: int = LOT) -> Iterator[list[tuple]]:
    """Rows, whose last column is a text, some at a time."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1] or "") + 1
        if size > chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def token_links(df: DataFrame, shared, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, groups, links)``: the aligned tokens of every document, and its links as
    places of their pairs among all possible ones, four bytes each."""
    def run(rows):
        both = sides(*shared.value)
        for lot in in_lots(rows):
            cut = [both.stretches(t or "") for _, t in lot]
            flat = both.parts([s for some in cut for s in some])
            at = 0
            for (i, _), some in zip(lot, cut, strict=True):
                parts = flat[at:at + len(some)]
                at += len(some)
                if parts and False not in parts:
                    n_a, n_b, links, groups = zip(*parts, strict=True)
                    places = b"".join(links)
                    yield i, sum(n_a), sum(n_b), len(places) // 4, ";".join(groups), places
                else:
                    yield i, 0, 0, 0, "", b""

    kind = df.schema[doc_id].dataType.simpleString()
    return map_rows(pick(df, id=doc_id, text=text), run,
                    f"doc_id {kind}, n_a long, n_b long, n_groups long, groups string, links binary", 50)


def pair_counts(found: DataFrame, width: int) -> DataFrame:
    """``(pair, n)``: how many links hold each pair; every task adds up its own first."""
    def run(rows):
        counts = np.zeros(width, np.int64)
        for (links,) in rows:
            np.add.at(counts, np.frombuffer(links, np.uint32), 1)
        used = np.flatnonzero(counts)
        return zip(used.tolist(), counts[used].tolist(), strict=True)

    return map_rows(found.select("links"), run, "pair long, n long", 50_000).groupBy("pair").agg(F.sum("n").alias("n"))


def aligned(df: DataFrame, byte_json_path: str, piece_model_path: str, doc_id: str = "doc_id", text: str = "text",
            keep: Callable[[Column], Column] = lambda groups: groups) -> DataFrame:
    """One row per document: ``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups)``.

    ``groups`` spells the id groups in order: ``a1,a2|b1;a3|b2,b3``, or is what ``keep`` makes of that text
    (a digest, say), so that the text itself need not be stored.  Links are the pairs of tokens that
    end together, one a group.  ``count_sum`` adds up how often the pair of each link is linked
    in the whole corpus, ``n_best`` counts the links whose pair no other pair of its B id exceeds.

    Null and empty texts, and texts that B does not spell as they are (a literal U+2581),
    have no tokens: zeros and empty ``groups``; they add to no count.  Repeated rows and null ids stand for
    themselves; other columns are ignored; an empty table gives none.

    Texts are read, encoded and aligned once and never shuffled.  Four bytes a link are written to the shared
    folder; pairs are counted from there, and the counts looked up.
    """
    with open(byte_json_path, encoding="utf-8") as file, open(piece_model_path, "rb") as model:
        files = file.read(), model.read()  # a vocabulary has a fixed size (about 3 MB)
    context = df.sparkSession.sparkContext
    shared = context.broadcast(files)
    done = token_links(df, shared, doc_id, text)
    done = cut_lineage(done.withColumn("groups", F.when(F.col("n_a") > 0, keep(F.col("groups"))).otherwise(F.lit(""))))
    pairs, width = (lambda both: (both.pairs, both.width))(sides(*files))
    found = pair_counts(done, len(pairs)).collect()  # bounded by the vocabularies
    counts = np.zeros(len(pairs), np.int64)
    counts[[r.pair for r in found]] = [r.n for r in found]
    highest = np.zeros(width, np.int64)
    np.maximum.at(highest, pairs % width, counts)
    table = context.broadcast((counts, counts == highest[pairs % width]))

    def run(rows):
        counts, best = table.value
        for *row, links in rows:
            at = np.frombuffer(links, np.uint32)
            yield *row, int(best[at].sum()), int(counts[at].sum())

    columns = ["doc_id", "n_a", "n_b", "n_groups", "groups"]
    kinds = ", ".join(f"{c} {done.schema[c].dataType.simpleString()}" for c in columns)
    summed = map_rows(done.select(*columns, "links"), run, f"{kinds}, n_best long, count_sum long")
    return summed.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups")
