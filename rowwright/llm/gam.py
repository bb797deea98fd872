"""Text quality by a generalised additive model with pairwise interactions.

Every feature is cut into bins at quantiles.  Boosting goes round the features: each turn
fits a shallow tree to what is not yet explained and adds its leaves to the feature's
look-up table; then pairs of features get tables of two dimensions in the same way.  The
score of a text is the sum of one table entry per feature and pair.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import share
from ..session import cut_lineage
from .common import IN_ROWS, map_rows, pick, remainder

#: Labelled rows used for fitting, at most (about); larger sets are thinned by a hash of the id.
SAMPLE = 50_000
BINS, COARSE, PAIRS = 48, 12, 8
ROUNDS, PAIR_ROUNDS, RATE = 60, 40, 0.15
NAMES = ("words", "word length", "distinct words", "same as word before", "short words", "long words", "upper case",
         "digits", "symbols", "exclamations", "bars", "full stops", "commas", "lines", "distinct lines", "other bytes",
         "spread of bytes", "words starting upper")

_CLASS = np.zeros((256, 9))
for _i, _set in enumerate((range(65, 91), range(97, 123), range(48, 58), b"#$%&*+/<=>@[\\]^_`{}~", b"!?", b"|", b".", b",;:", range(128, 256))):
    _CLASS[list(_set), _i] = 1


def features(text: str | None) -> list[float]:
    """Figures of one whole text; all zero without words."""
    data = (text or "").encode()
    words = data.split()
    if not words:
        return [0.0] * len(NAMES)
    n = len(words)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper, lower, digit, symbol, calls, bars, stops, commas, other = (counts @ _CLASS).tolist()
    sizes = np.fromiter(map(len, words), np.int64, n)
    solid = int(sizes.sum())
    part = counts[counts > 0] / len(data)
    rows = data.split(b"\n")
    return [
        float(np.log1p(n)), solid / n, len(set(words)) / n, sum(map(bytes.__eq__, words, words[1:])) / n,
        float((sizes <= 3).mean()), float((sizes >= 12).mean()), upper / max(1.0, upper + lower), digit / solid, symbol / solid,
        calls / n, bars / n, stops / n, commas / n, len(rows) / n, len(set(rows)) / len(rows), other / len(data),
        float(-(part * np.log2(part)).sum()), sum(w[0] in range(65, 91) for w in words) / n,
    ]


@dataclass
class Model:
    """Bin edges of each feature, look-up tables of features and pairs, and the log odds at the start."""

    edges: list[np.ndarray]
    start: float
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of features: one addition per table for all rows at once."""
        total = np.full(len(rows), self.start)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[j], rows[:, j], side="right")]
        for a, b, table in self.pairs:
            total += table[np.searchsorted(self.coarse[a], rows[:, a], side="right"),
                           np.searchsorted(self.coarse[b], rows[:, b], side="right")]
        return 1 / (1 + np.exp(-total))


def _leaves(push: np.ndarray, mass: np.ndarray, depth: int = 2, least: float = 2.0) -> np.ndarray:
    """Newton steps of a tree of ``depth`` over ordered bins, from sums of gradients and curvatures."""
    value = np.full(len(push), push.sum() / (mass.sum() + 1.0))
    if depth and len(push) > 1:
        g, h = np.cumsum(push)[:-1], np.cumsum(mass)[:-1]
        rest_g, rest_h = push.sum() - g, mass.sum() - h
        gain = np.where((h > least) & (rest_h > least), g * g / (h + 1) + rest_g * rest_g / (rest_h + 1), 0)
        if gain.max() > push.sum() ** 2 / (mass.sum() + 1):
            at = int(gain.argmax()) + 1
            value[:at] = _leaves(push[:at], mass[:at], depth - 1, least)
            value[at:] = _leaves(push[at:], mass[at:], depth - 1, least)
    return value


def _quadrants(push: np.ndarray, mass: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of a grid into four: its gain and the Newton step of every cell."""
    def corners(x):
        c = x.cumsum(0).cumsum(1)
        top, left, low = c[:-1, -1:], c[-1:, :-1], c[:-1, :-1]
        return np.stack([low, top - low, left - low, c[-1, -1] - top - left + low])

    g, h = corners(push), corners(mass)
    gain = (g * g / (h + 1)).sum(0)
    a, b = np.unravel_index(gain.argmax(), gain.shape)
    step = g[:, a, b] / (h[:, a, b] + 1)
    grid = np.empty_like(push)
    grid[:a + 1, :b + 1], grid[:a + 1, b + 1:], grid[a + 1:, :b + 1], grid[a + 1:, b + 1:] = step
    return float(gain[a, b]), grid


def fit(rows: np.ndarray, labels: np.ndarray) -> Model:
    """Cyclic boosting.  Without rows every text scores 0.5; with one label, near that label."""
    n, width = rows.shape
    cut = lambda j, k: np.unique(np.quantile(rows[:, j], np.arange(1, k) / k)) if n else np.empty(0)
    edges, coarse = [cut(j, BINS) for j in range(width)], [cut(j, COARSE) for j in range(width)]
    positive = (labels.sum() + 0.5) / (n + 1.0)
    model = Model(edges, float(np.log(positive / (1 - positive))), [np.zeros(len(e) + 1) for e in edges], coarse, [])
    if not n or labels.min() == labels.max():
        return model
    place = [np.searchsorted(edges[j], rows[:, j], side="right") for j in range(width)]
    rough = [np.searchsorted(coarse[j], rows[:, j], side="right") for j in range(width)]
    total = np.full(n, model.start)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return labels - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(width):
            g, h = slopes()
            size = len(edges[j]) + 1
            step = RATE * _leaves(np.bincount(place[j], g, size), np.bincount(place[j], h, size))
            model.tables[j] += step
            total += step[place[j]]

    def grid(a, b, g, h):
        shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
        flat = rough[a] * shape[1] + rough[b]
        return [np.bincount(flat, x, shape[0] * shape[1]).reshape(shape) for x in (g, h)]

    g, h = slopes()
    able = [j for j in range(width) if len(coarse[j])]
    gains = sorted(((_quadrants(*grid(a, b, g, h))[0], a, b) for a, b in combinations(able, 2)), reverse=True)
    model.pairs = [(a, b, np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1))) for _, a, b in gains[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for a, b, table in model.pairs:
            step = RATE * _quadrants(*grid(a, b, *slopes()))[1]
            table += step
            total += step[rough[a], rough[b]]
    return model


def feature_table(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, features)`` of every whole text; one narrow pass."""
    kind = df.schema[doc_id].dataType.simpleString()
    return map_rows(pick(df, id=doc_id, text=text), lambda rows: ((i, features(t)) for i, t in rows),
                    f"doc_id {kind}, features array<double>")


def train(found: DataFrame, labels: DataFrame, sample: int = SAMPLE, label: str = "quality") -> Model:
    """Fit on labelled rows outside the held-out third.  Rows without id or label are left out; an
    id labelled twice counts twice.  About ``sample`` rows at most reach the driver, as figures only."""
    known = pick(labels, label_id="doc_id", label=label).filter("label IS NOT NULL")
    known = known.filter(remainder("label_id", 3) != 1)
    rows = cut_lineage(found.join(known, F.col("doc_id") == F.col("label_id")).select("doc_id", "features", "label"))
    part = min(1.0, sample / max(1, rows.count()))
    taken = rows.filter(share(F.col("doc_id"), "sample") < part).select("features", "label").collect()
    if not taken:
        return fit(np.empty((0, len(NAMES))), np.empty(0))
    data = np.array(sorted([*r.features, float(r.label > 0)] for r in taken))
    return fit(data[:, :-1], data[:, -1])


def scores(found: DataFrame, model: Model, doc_id_kind: str) -> DataFrame:
    def run(rows):
        held: list[tuple] = []

        def flush():
            values = model.score(np.array([f for _, f in held]))
            return [(i, float(v)) for (i, _), v in zip(held, values, strict=True)]

        for row in rows:
            held.append(row)
            if len(held) == 4096:
                yield from flush()
                held = []
        if held:
            yield from flush()

    return map_rows(found.select("doc_id", "features"), run, f"doc_id {doc_id_kind}, score double")


def quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row per document: ``(doc_id, held_out, score, predicted)``.

    Held out are ids whose crc32 as text leaves 1 when divided by 3; null ids count as empty text.
    Scores depend on the text alone, so equal texts score alike; null and empty texts get
    the score of a text without words.  Repeated rows and null ids stand for themselves, other columns are ignored, and an
    empty table gives no rows.  Texts are read once; only figures are shuffled.
    """
    found = cut_lineage(feature_table(docs, doc_id, text))
    done = scores(found, train(found, labels, sample), docs.schema[doc_id].dataType.simpleString())
    return done.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score",
                       (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_rejected(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier accepts; fitted on the labelled documents only.

    Each row is judged by its text alone: null and empty texts as a text without words, repeated rows and rows without
    id like any other.  Rows pass as they are, some at a time, whatever their other columns are called.  Without
    labels every text scores 0.5 and stays; an empty table stays empty.
    """
    known = pick(labels, label_id="doc_id").filter(F.col("label_id").isNotNull() & (remainder("label_id", 3) != 1)).distinct()
    rows = pick(docs, doc_id=doc_id, text=text)
    both = cut_lineage(rows.select("doc_id").join(known, F.col("doc_id") == F.col("label_id"), "left_semi").distinct())
    # ids meet first, so that only texts to learn from are looked up, about ``sample`` ids at most
    part = min(1.0, sample / max(1, both.count()))
    chosen = F.broadcast(both.filter(share(F.col("doc_id"), "sample") < part).select(F.col("doc_id").alias("chosen_id")))
    some = rows.join(chosen, F.col("doc_id") == F.col("chosen_id"), "left_semi")
    model = train(feature_table(some), labels, sample)
    place = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, IN_ROWS):
                part = batch.slice(at, IN_ROWS)
                rows = np.array([features(t) for t in part.column(place).to_pylist()]).reshape(part.num_rows, len(NAMES))
                yield part.filter(pa.array(model.score(rows) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
