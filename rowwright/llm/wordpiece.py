"""Lengths of greedy word pieces, in time linear in the text.

The vocabulary becomes a trie.  Every node knows where matching goes on when its path
can be followed no further (its failure link), and how many pieces are complete by
then.  Counting a word follows arcs and links and adds those numbers; no piece is built
and no character is read twice.
"""

from __future__ import annotations

from collections import deque
from functools import lru_cache

from pyspark.sql import DataFrame

from .bpe import Pieces, read_ranks
from .common import map_rows, pick

NONE, BITS = -1, 40


class LongestMatch:
    """Counts pieces by longest match from the left.

    ``first`` holds pieces that may start a word, ``inside`` those that may follow (the
    same set when left out).  A word that cannot be cut into pieces counts as one.
    """

    def __init__(self, first: list[bytes], inside: list[bytes] | None = None):
        self.arcs: list[dict[int, int]] = [{}]
        self.ends: list[bool] = [False]
        self._add(0, first)
        self.root, self.inside = 0, 0
        if inside is not None:
            self.inside = self._node()
            self._add(self.inside, inside)
        self._link()

    def _node(self) -> int:
        self.arcs.append({})
        self.ends.append(False)
        return len(self.arcs) - 1

    def _add(self, root: int, pieces: list[bytes]) -> None:
        for piece in filter(None, pieces):
            node = root
            for byte in piece:
                if byte not in self.arcs[node]:
                    self.arcs[node][byte] = self._node()
                node = self.arcs[node][byte]
            self.ends[node] = True

    def _link(self) -> None:
        """Failure links, breadth first: a node's link needs those of shorter paths only."""
        size = len(self.arcs)
        self.link, self.popped = [NONE] * size, [0] * size
        queue = deque(dict.fromkeys((self.root, self.inside)))
        while queue:
            node = queue.popleft()
            for byte, child in self.arcs[node].items():
                if self.ends[child]:
                    self.link[child], self.popped[child] = self.inside, 1
                else:
                    at, count = self.link[node], self.popped[node]
                    while at != NONE and byte not in self.arcs[at]:
                        count += self.popped[at]
                        at = self.link[at]
                    if at != NONE:
                        self.link[child], self.popped[child] = self.arcs[at][byte], count
                queue.append(child)

    def count(self, word: bytes) -> int:
        arcs, link, popped = self.arcs, self.link, self.popped
        node, count = self.root, 0
        for byte in word:
            while byte not in arcs[node]:
                count += popped[node]
                node = link[node]
                if node == NONE:
                    return 1
            node = arcs[node][byte]
        while node != self.inside and node != self.root:
            count += popped[node]
            node = link[node]
            if node == NONE:
                return 1
        return count


@lru_cache(maxsize=4)
def _counter(data: bytes, pattern: str) -> Pieces:
    """Words and pieces of a text in one number: words in the bits above ``BITS``."""
    machine = LongestMatch(read_ranks(data))
    return Pieces(pattern, lambda word: 1 << BITS | machine.count(word.encode()), 0)


def count_pieces(df: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_pieces)``: words are the matches of ``pattern``, pieces the greedy longest
    tokens of the vocabulary file; null and empty texts have none of either.

    One narrow pass over whole texts; repeated rows stay rows of their own.  The vocabulary
    file has a fixed size (about 1 MB) and is broadcast.
    """
    with open(ranks_path, "rb") as file:
        ranks = df.sparkSession.sparkContext.broadcast(file.read())

    def run(rows):
        counts = _counter(ranks.value, pattern)
        for i, t in rows:
            total = sum(counts.parts(t or ""))
            yield i, total >> BITS, total & ((1 << BITS) - 1)

    kind = df.schema[doc_id].dataType.simpleString()
    return map_rows(pick(df, id=doc_id, text=text), run, f"doc_id {kind}, n_words long, n_pieces long")
