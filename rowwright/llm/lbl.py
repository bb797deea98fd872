"""Scoring texts with a log-bilinear language model trained by noise-contrastive estimation.

The model predicts the next of the most frequent words, or "some other word", from the two
words before: their vectors, weighted by place, are compared with the vector of each word.
Which other word it is follows its count.  Noise-contrastive estimation trains without
normalising; scores are normalised exactly, once for each pair of words before.

Every task trains a copy on its own documents from the same start; the copies are averaged
by the number of words they saw.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import map_rows, pick, remainder

#: Words the model predicts one by one, and numbers of a word vector.
WORDS, SIZE = 2047, 24
#: Words whose counts are broadcast, and the longest of them in bytes (at most 8 MB); all others are joined.
COMMON, LONGEST = 2**18, 32
#: Noise words a batch; places a batch; step size.
NOISE, BATCH, RATE = 128, 2048, 0.08
#: Logits held at a time while sums are made.
CELLS = 2**20
#: Distinct words a task counts before it hands them on.
HELD = 400_000
SLICES = 8
END = ""  # no word is empty


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """``(word, n)`` of all texts, ends included."""
    def run(rows):
        counts: Counter = Counter()
        ends = 0
        for (t,) in rows:
            counts.update(words(t))
            ends += 1
            if len(counts) > HELD:
                yield from ((w.decode(), n) for w, n in counts.items())
                counts.clear()
        yield from ((w.decode(), n) for w, n in counts.items())
        if ends:
            yield END, ends

    return map_rows(pick(df, text=text), run, "word string, n long", 20_000).groupBy("word").agg(F.sum("n").alias("n"))


def common_words(counts: DataFrame, limit: int) -> tuple[list[tuple[str, int]], DataFrame]:
    """At most ``limit`` most frequent words that are not long, with the end, and the counts of all others.

    The least count comes from a histogram over powers of 2^(1/8), so the number is bounded
    without sorting all words.
    """
    step = F.floor(F.log2("n") * 8)
    short = F.octet_length("word") <= LONGEST
    found = counts.filter(short).groupBy(step.alias("step")).count().collect()
    total, least = 0, max((r.step for r in found), default=0) + 1
    for r in sorted(found, key=lambda r: -r.step):
        total += r["count"]
        if total > limit:
            break
        least = r.step
    chosen = ((step >= least) & short) | (F.col("word") == END)
    rows = counts.filter(chosen).collect()
    return sorted(((r.word, r.n) for r in rows), key=lambda x: (-x[1], x[0])), counts.filter(~chosen)


class Model:
    """Vectors of the words before and after, weights by place, and biases, in one flat array."""

    def __init__(self, frequency: np.ndarray, flat: np.ndarray | None = None):
        k = len(frequency)
        self.shapes = [(k, SIZE), (k, SIZE), (2, SIZE), (k,)]
        self.noise = frequency / frequency.sum()
        self.scale = np.log(NOISE * self.noise).astype(np.float32)
        if flat is None:
            rng = np.random.default_rng(11)
            flat = np.concatenate([rng.normal(0, 0.05, 2 * k * SIZE), np.ones(2 * SIZE), np.log(self.noise)])
        self.flat = np.array(flat, np.float32)  # half the traffic of doubles; sums are doubles
        ends = np.cumsum([int(np.prod(s)) for s in self.shapes])
        parts = [self.flat[a:b].reshape(s) for a, b, s in zip([0, *ends], ends, self.shapes, strict=False)]
        self.before, self.after, self.place, self.bias = parts
        self.spent = [np.full(s, 1e-3, np.float32) for s in self.shapes]

    def context(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return self.before[one] * self.place[0] + self.before[two] * self.place[1]

    def _step(self, which: int, part: np.ndarray, lots: tuple, slope: np.ndarray) -> None:
        """Adagrad: steps shrink where there were many. Slopes of the same row are summed first."""
        order, starts, rows = lots
        slope, spent = slope[order], self.spent[which]
        spent[rows] += np.add.reduceat(slope * slope, starts)
        part[rows] += RATE * np.add.reduceat(slope, starts) / np.sqrt(spent[rows])

    def train(self, one: np.ndarray, two: np.ndarray, target: np.ndarray, rng: np.random.Generator) -> None:
        """One batch: tell the words that followed from noise words shared by the batch."""
        noise = rng.choice(len(self.bias), NOISE, p=self.noise)
        view = self.context(one, two)
        after, near = self.after[target], self.after[noise]
        real = (view * after).sum(1) + self.bias[target] - self.scale[target]
        down = view @ near.T
        down += self.bias[noise] - self.scale[noise]
        np.negative(down, out=down)
        np.exp(down, out=down)
        down += 1
        np.divide(-1, down, out=down)
        up = 1 / (1 + np.exp(real))
        pull = up[:, None] * after + down @ near
        slope = up[:, None] * view
        n = np.float32(len(target))
        to_noise, to_target, to_context = lots_of(noise), lots_of(target), lots_of(np.concatenate([one, two]))
        self._step(1, self.after, to_noise, down.T @ view / n)
        self._step(1, self.after, to_target, slope / n)
        self._step(3, self.bias, to_noise, down.sum(0) / n)
        self._step(3, self.bias, to_target, up / n)
        pull /= n
        places = np.stack([np.einsum("ij,ij->j", pull, self.before[one]), np.einsum("ij,ij->j", pull, self.before[two])])
        self._step(0, self.before, to_context, np.concatenate([pull * self.place[0], pull * self.place[1]]))
        self._step(2, self.place, lots_of(np.arange(2)), places)


def lots_of(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that brings equal rows together, where each begins in it, and the different rows."""
    order = np.argsort(rows.astype(np.uint16 if len(rows) and rows.max() < 2**16 else np.int64), kind="stable")
    rows = rows[order]
    starts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    return order, starts, rows[starts]


class Scorer:
    """Normalised log probabilities; the sum over all words is kept for each pair of words before."""

    def __init__(self, model: Model):
        self.model = model
        self.sums = np.full(len(model.bias) ** 2, np.nan, np.float32)

    def __call__(self, one: np.ndarray, two: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural logarithms of the probability of each target."""
        m, k = self.model, len(self.model.bias)
        pair = one * k + two
        fresh = np.unique(pair[np.isnan(self.sums[pair])])
        step = -(-CELLS // k)
        for at in range(0, len(fresh), step):
            some = fresh[at:at + step]
            logits = m.context(some // k, some % k) @ m.after.T
            logits += m.bias
            top = logits.max(1)
            logits -= top[:, None]
            self.sums[some] = top + np.log(np.exp(logits, out=logits).sum(1, dtype=np.float64))
        return (m.context(one, two) * m.after[target]).sum(1, dtype=np.float64) + m.bias[target] - self.sums[pair]


class Coder:
    """Ids of words: 0 .. WORDS - 1 the most frequent, then all other common ones; -1 is not common."""

    def __init__(self, common: list[tuple[str, int]]):
        self.common = common
        self.ids = {w.encode(): i for i, (w, _) in enumerate(common)}
        self.counts = np.array([n for _, n in common] or [0], np.float64)
        self.kept = min(WORDS, len(common))
        self.end = self.ids.get(b"", -1)

    def __call__(self, found: list[bytes]) -> np.ndarray:
        ids = np.empty(len(found) + 1, np.int64)
        ids[:-1] = np.fromiter(map(self.ids.get, found, repeat(-1)), np.int64, len(found))
        ids[-1] = self.end
        return ids

    def classes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The two words before each place (ends before the first) and the word there, others as one class."""
        target = np.where((ids >= 0) & (ids < self.kept), ids, self.kept)
        start = self.end if 0 <= self.end < self.kept else self.kept
        padded = np.concatenate([[start, start], target])
        return padded[1:-1], padded[:-2], target


_made: dict[int, Coder] = {}
_scorers: dict[int, Scorer] = {}


def coder(shared: Broadcast) -> Coder:
    """One coder per worker process; it keeps the list it was made from, so the key stays its own."""
    common = shared.value
    if id(common) not in _made:
        _made.clear()
        _made[id(common)] = Coder(common)
    return _made[id(common)]


def scorer(shared: Broadcast, frequency: np.ndarray) -> Scorer:
    """One scorer per worker process, so that a pair of words is normalised once for all tasks there."""
    flat = shared.value
    if id(flat) not in _scorers:
        _scorers.clear()
        _scorers[id(flat)] = Scorer(Model(frequency, flat))
        _scorers[id(flat)].source = flat  # kept, so that the key stays its own
    return _scorers[id(flat)]


def batches(places: Iterable[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    """Every place of all texts, in order, ``BATCH`` at a time; long texts are cut, short ones share a batch."""
    held: list[tuple] = []
    size = 0
    for parts in places:
        at, n = 0, len(parts[-1])
        while at < n:
            end = min(n, at + BATCH - size)
            held.append(tuple(p[at:end] for p in parts))
            size += end - at
            at = end
            if size == BATCH:
                yield tuple(map(np.concatenate, zip(*held, strict=True)))
                held, size = [], 0
    if size:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def fit(df: DataFrame, text: str, shared: Broadcast, frequency: np.ndarray) -> np.ndarray:
    """The average of the tasks' models, as one flat array of fixed length."""
    def run(rows):
        code, model = coder(shared), Model(frequency)
        rng = np.random.default_rng(3)
        seen = 0
        for batch in batches(code.classes(code(words(t))) for (t,) in rows):
            model.train(*batch, rng)
            seen += len(batch[-1])
        if seen:
            for s, part in enumerate(np.array_split(model.flat, SLICES)):
                yield s, seen, (part * np.float64(seen)).tobytes()

    def add(rows):
        sums: dict[int, list] = {}
        for s, seen, data in rows:
            part = np.frombuffer(data)
            n, total = sums.get(s, (0, 0.0))
            sums[s] = n + seen, total + part
        for s, (n, total) in sums.items():
            yield s, n, np.asarray(total / n).tobytes()

    schema = "slice int, seen long, data binary"
    sums = map_rows(map_rows(pick(df, text=text), run, schema).repartition(SLICES, "slice"), add, schema).collect()
    if not sums:
        return Model(frequency).flat
    return np.concatenate([np.frombuffer(r.data) for r in sorted(sums, key=lambda r: r.slice)])


def score_texts(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``.

    Tokens are words, A-Z in lower case, and one end.  Held out are ids whose crc32 as text leaves 2
    when divided by 7.  ``base_score`` is the add-one unigram score, ``score`` that of the model, both in
    decimal logarithms; words never seen share the weight of one.  Null and empty texts are
    one end; without training texts every word is unseen.

    Counts cover all training words.  The most frequent words are broadcast (bounded by
    ``COMMON`` and ``LONGEST``); the others meet their counts in a join, distinct per document.
    """
    rows = pick(df, doc_id=doc_id, text=text)
    learn = rows.filter(remainder("doc_id", 7) != 2)
    counts = cut_lineage(word_counts(learn, "text"))
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    common, others = common_words(counts, COMMON)
    shared = df.sparkSession.sparkContext.broadcast(common)
    kept = common[:WORDS]
    kept_n = sum(n for _, n in kept)
    rest = whole.n - kept_n + whole.v - len(kept) + 1  # counts of the other words plus one each, and one for the unseen
    frequency = np.array([float(n + 1) for _, n in kept] + [float(rest)])
    flat = df.sparkSession.sparkContext.broadcast(fit(learn, "text", shared, frequency))
    kind = df.schema[doc_id].dataType.simpleString()

    def run(source):
        code, score = coder(shared), scorer(flat, frequency)
        weight = np.log10(code.counts + 1)
        for i, t in source:
            found = words(t)
            ids = code(found)
            one, two, target = code.classes(ids)
            known = ids >= 0
            mine = weight[ids[known]]
            other = weight[ids[ids >= code.kept]].sum() - (target == code.kept).sum() * np.log10(rest)
            model = score(one, two, target).sum() / np.log(10) + other
            far = Counter(found[k] for k in np.flatnonzero(~known[:-1]).tolist())
            yield i, len(ids), int(known.sum()), float(mine.sum()), float(model), [{"word": w.decode(), "n": n} for w, n in far.items()]

    done = map_rows(rows, run, f"doc_id {kind}, n_tokens long, known long, base double, model double, "
                    "far array<struct<word:string,n:long>>", 500)
    done = cut_lineage(done.withColumn("row", F.monotonically_increasing_id()))
    far = done.select("row", F.inline("far")).withColumnRenamed("n", "times")
    met = far.join(others, "word").groupBy("row").agg(
        F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("gain"))
    joined = done.drop("far").join(met, "row", "left")
    gain = F.coalesce("gain", F.lit(0.0))
    floor = float(np.log10(whole.n + whole.v + 1))
    return joined.select(
        "doc_id", (remainder("doc_id", 7) == 2).alias("held_out"), "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(whole.n).cast("long").alias("train_tokens"),
        (F.col("base") + gain - F.col("n_tokens") * F.lit(floor)).alias("base_score"), (F.col("model") + gain).alias("score"))
