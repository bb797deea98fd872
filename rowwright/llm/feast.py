"""Whitening of embeddings with principal components found by contour integration (FEAST).

Vectors become whole numbers, so sums and products are added exactly and the covariance is the same
however the rows are dealt.  Its largest eigenvalues are enclosed in intervals by inertia counts:
the signs of the pivots of a shifted symmetric factorisation say how many eigenvalues lie above the shift.  For
each interval a contour integral of shifted complex solves projects random vectors onto its
eigenvectors, Rayleigh-Ritz extracts them, and the count says whether one is missing.
A last Rayleigh-Ritz step over all intervals makes close eigenvectors of neighbours orthogonal.

The rows are summed and projected in Spark.  On the driver lies only the covariance, whose size is that of a
vector squared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Steps to one, what is added to make entries positive, and components at most.
SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Points of the quadrature on the half circle, eigenvalues an interval at most, and rounds of refinement.
POINTS, SLICE, ROUNDS = 8, 12, 40
#: Rows whose products are added at a time.
ROWS = 8192


def inertia(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix lie above ``shift``: the positive pivots of the shifted
    matrix, in blocks of one or two as Bunch and Kaufman choose them."""
    a = matrix - shift * np.eye(len(matrix))
    above, tiny = 0, np.finfo(float).eps * max(1e-300, np.abs(a).max(initial=0))
    while len(a):
        column = np.abs(a[1:, 0])
        r = int(column.argmax()) + 1 if len(column) else 0
        most = column.max(initial=0)
        if most <= tiny:  # nothing to eliminate; a pivot of zero counts as not above
            above += int(a[0, 0] > tiny)
            a = a[1:, 1:]
            continue
        row = np.abs(np.delete(a[:, r], r)).max()
        ratio = 0.6403882032022076  # (1 + sqrt 17) / 8
        if abs(a[0, 0]) >= ratio * most or abs(a[0, 0]) * row >= ratio * most * most:
            size = 1
        elif abs(a[r, r]) >= ratio * row:
            size = 1
            a[[0, r]] = a[[r, 0]]
            a[:, [0, r]] = a[:, [r, 0]]
        else:
            size = 2
            a[[1, r]] = a[[r, 1]]
            a[:, [1, r]] = a[:, [r, 1]]
        pivot, below = a[:size, :size], a[size:, :size]
        if size == 1:
            above += int(pivot[0, 0] > 0)
        else:  # a block of two has one eigenvalue on each side unless its determinant is positive
            determinant = pivot[0, 0] * pivot[1, 1] - pivot[0, 1] ** 2
            above += 1 if determinant < 0 else 2 * int(pivot[0, 0] + pivot[1, 1] > 0)
        a = a[size:, size:] - below @ np.linalg.solve(pivot, below.T)
        a = (a + a.T) / 2
    return above


def slices(matrix: np.ndarray, wanted: int, least: float, most: int = SLICE) -> Iterator[tuple[float, float, int]]:
    """Intervals from the largest eigenvalue down, with their counts, that hold at least the ``wanted`` largest.

    Intervals are halved until they hold ``most`` eigenvalues; equal eigenvalues stay together, however many.
    """
    top = float(np.abs(matrix).sum(axis=1).max()) * 1.001 + least
    held = [(least / 2, top, inertia(matrix, least / 2), 0)]  # with the numbers above either end
    found = 0
    while held and found < wanted:
        low, high, more, fewer = held.pop()
        if more == fewer:
            continue
        middle = (low + high) / 2
        if more - fewer > most and high - low > 1e-13 * top:
            above = inertia(matrix, middle)
            held += [(low, middle, more, above), (middle, high, above, fewer)]
            continue
        found += more - fewer
        # the lower end moves up to the eigenvalues, away from a crowd at zero
        rise = next((high / 4**k for k in range(1, 24) if high / 4**k <= low or inertia(matrix, high / 4**k) == more), low)
        yield max(low, rise), high, more - fewer


def contour(matrix: np.ndarray, low: float, high: float, count: int, rng: np.random.Generator) -> np.ndarray:
    """Orthonormal vectors that span the eigenvectors of the ``count`` eigenvalues in an interval.

    Eigenvalues close to the ends from outside slow the rounds down; a wider subspace takes them in.
    """
    size = len(matrix)
    middle, radius = (low + high) / 2, (high - low) / 2
    points, weights = np.polynomial.legendre.leggauss(POINTS)
    turns = radius * np.exp(1j * np.pi / 2 * (1 - points))
    scale = np.abs(matrix).sum(axis=1).max()
    width = count + 8
    while True:
        width = min(size, width)
        some, before = np.linalg.qr(rng.normal(size=(size, width)))[0], np.inf
        for _ in range(ROUNDS):
            total = np.zeros((size, width))
            for turn, weight in zip(turns, weights, strict=True):
                solved = np.linalg.solve((middle + turn) * np.eye(size) - matrix, some.astype(complex))
                total += weight / 2 * (turn * solved).real
            basis = np.linalg.qr(total)[0]
            values, vectors = np.linalg.eigh(basis.T @ matrix @ basis)
            some = basis @ vectors
            wrong = np.abs(matrix @ some - some * values).max(axis=0)
            # vectors that are no eigenvectors can have a Ritz value in the interval, but never come close to one
            good = (values > low) & (values <= high) & (wrong <= 1e-11 * scale)
            now = wrong[good].max(initial=0)
            if good.sum() == count and (now >= before / 2 or now <= 1e-16 * scale):  # refined while that at least halves what is wrong
                return some[:, good]
            before = now if good.sum() == count else np.inf
        if width == size:
            raise ArithmeticError(f"{good.sum()} of {count} eigenvalues between {low} and {high} were found")
        width *= 2


def largest(matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest positive eigenvalues of a covariance, falling, and their unit eigenvectors as columns.

    Eigenvalues at the level of rounding count as zero.  Raises if an inertia count shows that one is missing.
    """
    size = len(matrix)
    least = size * np.finfo(float).eps * float(np.trace(matrix)) if size else 0.0
    if least <= 0 or not np.isfinite(least):
        return np.empty(0), np.empty((size, 0))
    rng = np.random.default_rng(17)
    parts = [contour(matrix, *interval, rng) for interval in slices(matrix, min(wanted, size), least)]
    if not parts:
        return np.empty(0), np.empty((size, 0))
    basis = np.linalg.qr(np.hstack(parts))[0]
    values, vectors = np.linalg.eigh(basis.T @ matrix @ basis)
    order = np.argsort(-values)[:wanted]
    values, vectors = values[order], (basis @ vectors)[:, order]
    values, vectors = values[values > least], vectors[:, values > least]
    if len(values):
        gap = 1e-11 * values[0]
        if inertia(matrix, float(values[-1]) + gap) > len(values) - 1:
            raise ArithmeticError("an eigenvalue is missing")
    return values, vectors


def whole_numbers(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``(vec_id, x)`` of the rows that remain; ``x`` are the entries as whole numbers."""
    entries = F.col("v")
    bad = F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = df.select(df[vec_id].alias("vec_id"), df[vector].cast("array<double>").alias("v")).filter(entries.isNotNull() & ~bad)
    return rows.select("vec_id", F.transform(entries, lambda c: F.floor(c * SCALE).cast("long") + SHIFT).alias("x"))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Record batches, some rows at a time, with their vectors (all of one length) as a matrix."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            flat = part.column(part.num_columns - 1).flatten().to_numpy(zero_copy_only=False)
            yield part, flat.reshape(part.num_rows, -1)


def moments(rows: DataFrame, size: int, centre: np.ndarray) -> tuple[int, list[int], list[list[int]], int]:
    """Number, sums and sums of products of the differences to ``centre``, and the largest difference; all exact.

    Each task adds up its rows; what it hands on has the size of a vector squared.
    """
    schema = "i int, j int, total string, most long"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    shared = rows.sparkSession.sparkContext.broadcast(centre)

    def run(batches):
        n, most = 0, 0
        sums = np.zeros(size, object)
        products = np.zeros((size, size), object)
        for _, x in _batches(batches):
            d = x - shared.value
            high = int(np.abs(d).max(initial=0))
            if high * high * len(d) < 2**53:  # whole numbers that doubles hold
                f = d.astype(np.float64)
                more = (f.T @ f).astype(np.int64)
            else:
                big = d.astype(object)
                more = big.T @ big
            products = products + more
            sums = sums + d.sum(axis=0, dtype=np.int64 if high < 2**40 else object)
            n, most = n + len(d), max(most, high)
        if n:
            i, j = np.triu_indices(size)
            totals = [str(n), *map(str, sums), *map(str, products[i, j])]
            left = np.concatenate([[-2], np.full(size, -1), i]).astype(np.int32)
            right = np.concatenate([[0], np.arange(size), j]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right), pa.array(totals), pa.array(np.full(len(left), most))], schema=arrow)

    sent = rows.select("x").mapInArrow(run, schema)
    sent = sent.select("i", "j", F.col("total").cast("decimal(38,0)").alias("total"), "most")
    found = sent.groupBy("i", "j").agg(F.sum("total").alias("total"), F.max("most").alias("most")).collect()
    sums, products = [0] * size, [[0] * size for _ in range(size)]
    n = most = 0
    for r in found:
        value, most = int(r.total), max(most, r.most)
        if r.i == -2:
            n = value
        elif r.i == -1:
            sums[r.j] = value
        else:
            products[r.i][r.j] = products[r.j][r.i] = value
    return n, sums, products, most


def covariance(n: int, sums: list[int], products: list[list[int]]) -> np.ndarray:
    """Covariance with divisor n, from exact sums: every entry is one rounded quotient."""
    size = len(sums)
    return np.array([[(n * products[i][j] - sums[i] * sums[j]) / (n * n) for j in range(size)] for i in range(size)]).reshape(size, size)


def whiten(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per remaining row and component: ``(vec_id, component, n, deviation, whitened, explained, identity_error)``.

    Rows whose vector is null or holds null or non-finite entries are left out.  An entry c counts as
    floor(64 * c) + 1000000.  Components are the eigenvectors of the covariance of all remaining rows, by falling
    eigenvalue; their sign is such that the largest entry is positive.  Components without variance are left out, as
    nothing can be divided by it, so equal vectors give no rows; nor do empty vectors or an empty table.
    Vectors of another length than most (of equal numbers the longer) have no place in the covariance and are left
    out.  Repeated rows and null ids stand for themselves; other columns are ignored.

    ``deviation`` is exact, as decimal(38,0).  ``identity_error`` is measured: the whitened rows are
    summed up in a pass of their own.
    """
    context = df.sparkSession.sparkContext
    every = whole_numbers(df, vec_id, vector)
    lengths = every.groupBy(F.size("x").alias("length")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("length")).first()
    size = lengths.length if lengths is not None else 0
    rows = every.filter(F.size("x") == size)
    first = rows.select("x").first() if size else None
    centre = np.array(first.x if first is not None else [], np.int64)
    n, sums, products, most = moments(rows, size, centre) if size else (0, [], [], 0)
    matrix = covariance(n, sums, products) if n else np.empty((0, 0))
    values, vectors = largest(matrix, components)
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))] < 0, -1, 1) if len(values) else vectors
    offset = np.array([s / n for s in sums]) if n else np.empty(0)  # S/n less the centre
    shared = context.broadcast((centre, np.array(sums, object), offset, vectors / np.sqrt(values)))
    narrow = most * most * size < 2**62 and most * max([abs(s) for s in sums], default=0) * size < 2**62

    def project(d):
        _, _, offset, weights = shared.value
        return (d - offset) @ weights

    def check(batches):
        total = np.zeros((len(values), len(values)))
        mean = np.zeros(len(values))
        for _, x in _batches(batches):
            w = project(x - shared.value[0])
            total += w.T @ w
            mean += w.sum(axis=0)
        i, j = np.triu_indices(len(values))
        yield pa.RecordBatch.from_arrays([
            pa.array(np.append(i, np.full(len(mean), -1)).astype(np.int32)), pa.array(np.append(j, np.arange(len(mean))).astype(np.int32)),
            pa.array(np.append(total[i, j], mean))], names=["i", "j", "total"])

    error = 0.0
    if len(values):
        sent = rows.select("x").mapInArrow(check, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total"))
        known = {(r.i, r.j): r.total / n for r in sent.collect()}
        error = max(abs(t - known[-1, i] * known[-1, j] - (i == j)) for (i, j), t in known.items() if i >= 0)

    kind = df.schema[vec_id].dataType.simpleString()
    out = f"vec_id {kind}, squares string, cross string, whitened array<double>"
    arrow = to_arrow_schema(StructType.fromDDL(out))

    def run(batches):
        for part, x in _batches(batches):
            centre, sums, *_ = shared.value
            d = x - centre
            if narrow:
                squares, cross = (d * d).sum(axis=1), d @ sums.astype(np.int64)
            else:
                big = d.astype(object)
                squares, cross = (big * big).sum(axis=1), big @ sums
            w = project(d)
            ends = np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]
            yield pa.RecordBatch.from_arrays([
                part.column(0).cast(arrow.field(0).type), pa.array([str(v) for v in squares.tolist()]), pa.array([str(v) for v in cross.tolist()]),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(w.ravel())).cast(arrow.field(3).type)], schema=arrow)

    explained = [float(v) / float(np.trace(matrix)) for v in values]
    whole = lambda v: F.lit(str(v)).cast("decimal(38,0)")
    n2, self_product = n * n, sum(s * s for s in sums)
    done = rows.select("vec_id", "x").mapInArrow(run, out)
    # |n d - s|^2 = n^2 d.d - 2 n d.s + s.s, in whole numbers
    deviation = whole(n2) * F.col("squares").cast("decimal(38,0)") - whole(2 * n) * F.col("cross").cast("decimal(38,0)") + whole(self_product)
    exploded = done.select("vec_id", deviation.cast("decimal(38,0)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return exploded.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(F.lit(explained or [0.0]), F.col("at") + 1).alias("explained"), F.lit(float(error)).alias("identity_error"))
