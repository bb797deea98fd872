"""The readings of the BPE transducer (``bpe``) for many short pieces at once.

Words that are met for the first time take most of an encoder's time.  Here the pieces of a batch are
columns of bytes, and all of them go on by one byte in one step of numpy: from each begin, every piece follows
the trie, and a token that may follow the one before ends where it ends.  Begins come in their order, so what ended
there is known.
"""

from __future__ import annotations

import numpy as np

#: Bytes of a piece that goes in step; longer ones are read by the machine alone.
SHORT = 32
#: Pieces that go in step.
ABREAST = 20_000
MIX = np.uint64(0x9E3779B97F4A7C15)


class Table:
    """Whole numbers by whole numbers of at least 0; -1 where there is none."""

    def __init__(self, known: dict[int, int]):
        keys, values = np.fromiter(known, np.int64, len(known)), np.fromiter(known.values(), np.int32, len(known))
        bits = max(4, int(4 * len(known)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        slots = self._slots(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slots] < 0)
            _, first = np.unique(slots[free], return_index=True)
            first = free[first]
            self.keys[slots[first]], self.values[slots[first]] = keys[first], values[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values, slots = keys[rest], values[rest], (slots[rest] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * MIX) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slots = self._slots(keys)
        held = self.keys[slots]
        found = self.values[slots]
        apart = np.flatnonzero((held != keys) & (held >= 0))
        found[held != keys] = -1
        slots = slots[apart]
        while len(apart):
            slots = (slots + 1) & self.mask
            held, wanted = self.keys[slots], keys[apart]
            met = held == wanted
            found[apart[met]] = self.values[slots[met]]
            on = ~met & (held >= 0)
            apart, slots = apart[on], slots[on]
        return found


class Lockstep:
    """Encodes lists of short pieces as ``machine`` (a ``bpe.Transducer``) would one by one."""

    def __init__(self, machine, nothing: int):
        self.machine, self.nothing = machine, nothing
        rank, tokens = machine.rank, machine.tokens
        self.arcs = Table(machine.arcs)
        self.ends = np.array(machine.ends, np.int32)
        self.inner = np.zeros(len(self.ends), bool)
        self.inner[list(machine.inner)] = True
        self.size = np.array([len(t) for t in tokens], np.int32)
        pairs = {}
        for i, token in enumerate(tokens):
            for at in range(1, len(token)):
                one, two = rank.get(token[:at]), rank.get(token[at:])
                if one is not None and two is not None:
                    pairs[one << 20 | two] = i
        self.joined = Table(pairs)
        # what a token was joined from; itself if it is a byte, -1 if not worked out yet, -2 if merging doesn't end in it
        self.left, self.right = np.full(len(tokens), -1, np.int32), np.full(len(tokens), -1, np.int32)

    def _work_out(self, token: int) -> None:
        todo = [token]
        while todo:
            token = todo.pop()
            if self.left[token] != -1:
                continue
            *_, last = steps = list(self.machine._merges(self.machine.tokens[token]))
            if len(last) > 1:
                self.left[token] = self.right[token] = -2
            elif len(steps) == 1:
                self.left[token] = self.right[token] = token
            else:
                parts = [self.machine.rank[p] for p in steps[-2]]
                self.left[token], self.right[token] = parts
                todo += parts

    def may_follow(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Whether no merge crosses the border.  Tokens are taken apart, the later joined first; a pair that could be
        joined before that (of equal ranks the left goes first) crosses it."""
        for token in np.unique(two[self.left[two] == -1]).tolist():
            self._work_out(token)
        fits = self.left[two] != -2
        at = np.flatnonzero(fits & (one != self.nothing))
        one, two = one[at].astype(np.int64), two[at].astype(np.int64)
        limit = np.full(len(at), len(self.size), np.int64)
        while len(at):
            joined = self.joined.get(one << 20 | two)
            crossed = (joined >= 0) & (joined < limit)
            fits[at[crossed]] = False
            inside, outside = self.right[one], self.left[two]
            apart_one, apart_two = inside != one, outside != two
            on = ~crossed & (apart_one | apart_two)
            first = (apart_one & ((one > two) | ~apart_two))[on]
            at, one, two, inside, outside = at[on], one[on], two[on], inside[on], outside[on]
            limit = np.where(first, one, two + 1)
            one, two = np.where(first, inside, one), np.where(first, two, outside)
        return fits

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Token ranks of each piece, four bytes each; no piece is empty or longer than ``SHORT``."""
        out: list[bytes] = [b""] * len(pieces)
        order = sorted(range(len(pieces)), key=lambda i: -len(pieces[i]))
        for begin in range(0, len(order), ABREAST):
            some = order[begin:begin + ABREAST]
            for i, ids in zip(some, self._abreast([pieces[i] for i in some]), strict=True):
                out[i] = ids
        return out

    def _abreast(self, pieces: list[bytes]):
        """Pieces come longest first, so those that go on at a place are the first ones."""
        longest = len(pieces[0])
        data = np.frombuffer(b"".join([p.ljust(longest, b"\0") for p in pieces]), np.uint8).reshape(len(pieces), longest)
        data = np.ascontiguousarray(data.T).astype(np.int64)
        sizes = np.array([len(p) for p in pieces])
        still = [int(np.count_nonzero(sizes > at)) for at in range(longest)]
        ended = np.full((longest + 1, len(pieces)), -1, np.int32)
        ended[0] = self.nothing
        for begin in range(longest):
            at = np.arange(still[begin])
            node = np.zeros(len(at), np.int64)
            met = []
            for end in range(begin, longest):
                on = int(np.searchsorted(at, still[end]))
                at, node = at[:on], node[:on]
                node = self.arcs.get(node << 8 | data[end][at])
                on = node >= 0
                at, node = at[on], node[on].astype(np.int64)
                if not len(at):
                    break
                token = self.ends[node]
                new = (token >= 0) & (ended[end + 1][at] < 0)
                if new.any():
                    met.append((np.full(np.count_nonzero(new), end + 1), at[new], token[new]))
                on = self.inner[node]
                at, node = at[on], node[on]
            if met:
                place, piece, token = map(np.concatenate, zip(*met, strict=True))
                fits = self.may_follow(ended[begin][piece], token)
                ended[place[fits], piece[fits]] = token[fits]
        return self._paths(ended, sizes)

    def _paths(self, ended: np.ndarray, sizes: np.ndarray):
        rows, at, most = np.arange(len(sizes)), sizes.copy(), int(sizes.max())
        found, counts = np.zeros((len(sizes), most), np.uint32), np.zeros(len(sizes), np.int64)
        for step in range(most):
            token = ended[at[rows], rows]
            found[rows, most - 1 - step] = token
            counts[rows] += 1
            at[rows] -= self.size[token]
            rows = rows[at[rows] > 0]
            if not len(rows):
                break
        raw = found.tobytes()
        for i, n in enumerate(counts.tolist()):
            yield raw[4 * (i * most + most - n):4 * (i + 1) * most]
