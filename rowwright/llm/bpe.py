"""Byte-level BPE by a lazily determinised transducer, and streaming decoding.

A sequence of tokens is the BPE encoding of a text exactly when every two neighbours
are the encoding of their joined bytes: merges never cross the border between two
final tokens, and which merge comes first inside a pair does not depend on what is
outside.  So the merges compile into a relation "may follow" between tokens, worked out
for a pair the first time it is asked for.

Reading bytes, the machine follows every token of the vocabulary trie that may still
be under way: a reading is (the token before, trie node).  The set of readings is one
state of the deterministic machine; states and arcs are made when first met.  An arc
gives the token that ends the encoding of what has been read so far.  No reading is longer
than the longest token, so tokens on the common path of all readings are emitted after
bounded lookahead.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache

import regex
from pyspark.sql import DataFrame

from .common import Memo, map_rows, pick
from .lockstep import SHORT, Lockstep

#: States kept before the machine forgets them and starts anew.
MAX_STATES = 150_000
#: Bytes of one piece between two looks for tokens that can be emitted.
STRETCH = 4_096
SEGMENT = 512
#: Characters of texts that are encoded together, and new pieces that are worth going in step.
BATCH, MANY = 1_000_000, 500
SHIFT, MASK = 20, (1 << 20) - 1
NOTHING = MASK  # stands for "no token before"


def read_ranks(data: bytes) -> list[bytes]:
    """Tokens by rank, from lines of base64 token and rank."""
    ranks = {int(r): base64.b64decode(t) for t, r in (line.split() for line in data.splitlines() if line)}
    return [ranks[i] for i in range(len(ranks))]


class Transducer:
    """Encodes byte strings; ``tokens`` by rank hold every single byte, and joins come after their parts."""

    def __init__(self, tokens: list[bytes], max_states: int = MAX_STATES):
        self.tokens, self.rank = tokens, {t: i for i, t in enumerate(tokens)}
        self.max_states = max_states
        self.arcs, self.ends, self.depth, self.inner = self._trie()
        self.edges = Memo(self._edges, 48 << 20)
        self.follows = Memo(lambda pair: self._may_follow(pair >> SHIFT, pair & MASK), 48 << 20)
        self._forget()

    def _trie(self) -> tuple[dict[int, int], list[int], list[int], set[int]]:
        arcs: dict[int, int] = {}
        ends, depth, inner = [-1], [0], {0}
        for i, token in enumerate(self.tokens):
            node = 0
            for byte in token:
                key = node << 8 | byte
                inner.add(node)
                if key not in arcs:
                    arcs[key] = len(ends)
                    ends.append(-1)
                    depth.append(depth[node] + 1)
                node = arcs[key]
            ends[node] = i
        return arcs, ends, depth, inner

    def _merges(self, data: bytes):
        """The definition: join the neighbours of least rank, leftmost first, until none is left."""
        parts = [bytes([b]) for b in data]
        yield parts
        while len(parts) > 1:
            joined = [self.rank.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
            least = min((r for r in joined if r is not None), default=None)
            if least is None:
                break
            at = joined.index(least)
            parts = [*parts[:at], parts[at] + parts[at + 1], *parts[at + 2:]]
            yield parts

    def merge(self, data: bytes) -> list[int]:
        *_, parts = self._merges(data)
        return [self.rank[p] for p in parts]

    def _edges(self, token: int) -> tuple[list[tuple[bytes, int, int]], list[tuple[bytes, int, int]]] | None:
        """The parts that stand at the left and at the right edge of a token while it is merged,
        each with the ranks that make it and make the next; None if merging doesn't end in the token."""
        *_, last = steps = list(self._merges(self.tokens[token]))
        if len(last) > 1:
            return None
        sides = []
        for at in (0, -1):
            parts = list(dict.fromkeys(step[at] for step in steps))
            made = [-1, *[self.rank[p] for p in parts[1:]], len(self.tokens)]
            sides.append(list(zip(parts, made, made[1:], strict=False)))
        return sides[0], sides[1]

    def _may_follow(self, one: int, two: int) -> bool:
        """Whether no merge crosses the border.  Merges run by rank, so a part at the edge is there
        from the rank that makes it to the rank that makes the next; of equal ranks the left goes first."""
        right, left = self.edges[one][1], self.edges[two][0]
        for a, a_made, a_gone in right:
            for b, b_made, b_gone in left:
                joined = self.rank.get(a + b)
                if joined is not None and a_made < joined < a_gone and b_made < joined <= b_gone:
                    return False
        return True

    def _forget(self) -> None:
        self.states: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        self.moves: dict[int, int] = {}
        self.start = self._state((NOTHING << SHIFT,))

    def _state(self, readings: tuple[int, ...]) -> int:
        found = self.number.setdefault(readings, len(self.states))
        if found == len(self.states):
            self.states.append(readings)
        return found

    def _move(self, state: int, byte: int) -> int:
        """Make one arc: the next state and the token that ends there."""
        found, ended = [], -1
        for reading in self.states[state]:
            before, node = reading >> SHIFT, reading & MASK
            node = self.arcs.get(node << 8 | byte)
            if node is None:
                continue
            if node in self.inner:
                found.append(before << SHIFT | node)
            token = self.ends[node]
            if ended < 0 <= token and self.edges[token] and (before == NOTHING or self.follows[before << SHIFT | token]):
                ended = token
        found.append(ended << SHIFT)
        arc = self.moves[state << 8 | byte] = self._state(tuple(found)) << SHIFT | ended
        return arc

    def _path(self, ended: list[int], at: int) -> list[int]:
        """The tokens that lead to a place, last first."""
        out = []
        while at:
            out.append(ended[at])
            at -= len(self.tokens[ended[at]])
        return out

    def encode(self, data: bytes) -> list[int]:
        """Token ranks of one piece of text."""
        out: list[int] = []
        if len(self.states) > self.max_states:
            self._forget()
        state, ended = self.start, [NOTHING]
        for at in range(0, len(data), STRETCH):
            if at:
                state, ended = self._emit(state, ended, out)
            moves, add = self.moves, ended.append
            for byte in data[at:at + STRETCH]:
                arc = moves.get(state << 8 | byte)
                if arc is None:
                    arc = self._move(state, byte)
                state = arc >> SHIFT
                add(arc & MASK)
        return out + self._path(ended, len(ended) - 1)[::-1]

    def _emit(self, state: int, ended: list[int], out: list[int]):
        """Move the tokens on the common path of all readings to ``out`` and forget their bytes."""
        readings = self.states[state]
        paths = [self._path(ended, len(ended) - 1 - self.depth[r & MASK])[::-1] for r in readings]
        shared = 0
        while all(len(p) > shared and p[shared] == paths[0][shared] for p in paths):
            shared += 1
        out += paths[0][:shared]
        gone = sum(len(self.tokens[t]) for t in paths[0][:shared])
        if len(self.states) > self.max_states:
            self._forget()
            state = self._state(readings)
        return state, [NOTHING, *ended[gone + 1:]]


class Utf8Stream:
    """Incremental UTF-8: takes tokens, gives the characters that are complete.

    The state is the bytes still needed and the range the next one must be in; a broken
    sequence gives one U+FFFD, and the byte that broke it is read anew.
    """

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.whole = [self._whole(t) for t in tokens]
        self.reset()

    @staticmethod
    def _whole(token: bytes) -> str | None:
        try:
            return token.decode()
        except UnicodeDecodeError:
            return None

    def reset(self) -> None:
        self.need, self.low, self.high, self.held = 0, 0x80, 0xBF, bytearray()

    def _first(self, byte: int) -> str:
        if byte < 0x80:
            return chr(byte)
        if not 0xC2 <= byte <= 0xF4:
            return "�"
        self.need = 1 + (byte >= 0xE0) + (byte >= 0xF0)
        self.low = {0xE0: 0xA0, 0xF0: 0x90}.get(byte, 0x80)
        self.high = {0xED: 0x9F, 0xF4: 0x8F}.get(byte, 0xBF)
        self.held = bytearray([byte])
        return ""

    def _byte(self, byte: int) -> str:
        if not self.need:
            return self._first(byte)
        if not self.low <= byte <= self.high:
            self.reset()
            return "�" + self._first(byte)
        self.held.append(byte)
        self.need, self.low, self.high = self.need - 1, 0x80, 0xBF
        if self.need:
            return ""
        text = self.held.decode()
        self.held = bytearray()
        return text

    def feed(self, ids: list[int]) -> str:
        """Characters completed by these tokens."""
        if not self.need:
            try:
                return "".join(map(self.whole.__getitem__, ids))
            except TypeError:  # some token ends inside a character
                pass
        out = []
        for i in ids:
            whole = self.whole[i]
            if whole is not None and not self.need:
                out.append(whole)
            else:
                out += map(self._byte, self.tokens[i])
        return "".join(out)

    def end(self) -> str:
        """What is left at the end of the stream: nothing, or one mark for a cut character."""
        cut = "�" if self.need else ""
        self.reset()
        return cut


#: Characters of a word that is remembered; longer stretches are cut into pieces each time.
WORD = 64


class Pieces:
    """Applies ``function`` to every match of ``pattern`` and adds the results up, remembering words.

    The pattern must treat a lone space between two characters that are not white space as the start
    of a piece (patterns of public byte-level tokenizers do).  So a text is cut before each such
    space only, and a word met again costs one look-up; any other white space stays inside its stretch.
    """

    def __init__(self, pattern: str, function, nothing, limit: int = 40 << 20):
        self.split, self.nothing = regex.compile(pattern).findall, nothing
        self.cut = regex.compile(r"(?<=\S) (?=\S)").split
        self.pieces = Memo(function, limit)
        self.words = Memo(lambda word: self._sum(" " + word), limit)

    def _sum(self, text: str):
        total = self.nothing
        for value in map(self.pieces.__getitem__, self.split(text)):
            total += value
        return total

    def parts(self, text: str) -> list:
        """Results that add up to that of the text."""
        first, *words = self.cut(text)
        parts = [self.pieces[p] for p in self.split(first)]
        for word in words:
            if len(word) <= WORD:
                parts.append(self.words[word])
            else:
                parts += [self.pieces[p] for p in self.split(" " + word)]
        return parts


class Codec:
    """Encoder and decoder of whole texts; matches of ``pattern`` are encoded one by one and remembered.

    Many short pieces not met before go through the machine in step, all others alone."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.machine, self.stream = tokens, Transducer(tokens), Utf8Stream(tokens)
        self.split, self.pieces, self.fresh = regex.compile(pattern).findall, Memo(self._piece, 80 << 20), {}

    @cached_property
    def abreast(self) -> Lockstep:
        return Lockstep(self.machine, NOTHING)

    def _piece(self, piece: str) -> bytes:
        """Ranks of one piece, four bytes each; a piece that is a token stays one."""
        known = self.fresh.get(piece)
        if known is not None:
            return known
        data = piece.encode()
        whole = self.machine.rank.get(data)
        return array("I", [whole] if whole is not None else self.machine.encode(data)).tobytes()

    def _meet(self, pieces: set[str]) -> None:
        known, older, rank = self.pieces, self.pieces.older, self.machine.rank
        new = {p: p.encode() for p in pieces if p not in known and p not in older}
        new = {p: data for p, data in new.items() if len(data) <= SHORT and data not in rank}
        self.fresh = dict(zip(new, self.abreast.encode(list(new.values())), strict=True)) if len(new) >= MANY else {}

    def encode_all(self, texts: list[str]) -> list[array]:
        """Token ranks of texts that are small enough together to be cut up at once."""
        cut = [self.split(t) for t in texts]
        self._meet(set().union(*cut))
        return [array("I", b"".join(map(self.pieces.__getitem__, pieces))) for pieces in cut]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def encode_rows(self, rows: Iterable[tuple]) -> Iterator[tuple]:
        """``(id, text)`` to ``(id, ranks)``, in batches of some ``BATCH`` characters; null is an empty text."""
        held, size = [], 0

        def batch():
            found = self.encode_all([t for _, t in held])
            return [(i, ids.tolist()) for (i, _), ids in zip(held, found, strict=True)]

        for i, text in rows:
            held.append((i, text or ""))
            size += len(held[-1][1]) + 100
            if size >= BATCH:
                yield from batch()
                held, size = [], 0
        yield from batch()

    def decode(self, ids: list[int]) -> str:
        stream = self.stream
        stream.reset()
        parts = [stream.feed(ids[i:i + SEGMENT]) for i in range(0, len(ids), SEGMENT)]
        return "".join(parts) + stream.end()


@lru_cache(maxsize=4)
def codec(data: bytes, pattern: str) -> Codec:
    """One codec per worker process, however many tasks it runs."""
    return Codec(read_ranks(data), pattern)


def _shared(df: DataFrame, path: str):
    """The rank file as a broadcast; a vocabulary has a fixed size (about 1 MB)."""
    with open(path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode_texts(df: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, ids)``: token ranks of every whole text; null and empty texts have none.

    One narrow pass.  Rows with equal ids or texts stay separate rows; other columns are ignored.
    """
    ranks = _shared(df, ranks_path)

    def run(rows):
        coder = codec(ranks.value, pattern)
        return coder.encode_rows(rows)

    kind = df.schema[doc_id].dataType.simpleString()
    return map_rows(pick(df, id=doc_id, text=text), run, f"doc_id {kind}, ids array<int>", 200)


def decode_ids(df: DataFrame, ranks_path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``(doc_id, text)``: the text of token ranks, broken characters as U+FFFD; null ids give an empty text."""
    ranks = _shared(df, ranks_path)

    def run(rows):
        coder = codec(ranks.value, "")
        return ((i, coder.decode(list(x or ()))) for i, x in rows)

    kind = df.schema[doc_id].dataType.simpleString()
    return map_rows(pick(df, id=doc_id, ids=ids), run, f"doc_id {kind}, text string", 200)


def round_trip(df: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: encode, decode the ranks, digest both.

    One narrow pass; ids never leave the task that made them.  Null and empty texts have
    no tokens and the digests of nothing.
    """
    ranks = _shared(df, ranks_path)

    def run(rows):
        coder = codec(ranks.value, pattern)
        names = [str(i) for i in range(len(coder.tokens))].__getitem__
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for i, ids in coder.encode_rows(rows):
            yield i, len(ids), digest(" ".join(map(names, ids))), digest(coder.decode(ids))

    kind = df.schema[doc_id].dataType.simpleString()
    return map_rows(pick(df, id=doc_id, text=text), run,
                    f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
