"""Embedding whitening by shifted Cholesky QR.

Every vector becomes a row of integers, and the fit list holds each distinct row once.
Its centred rows are orthogonalised by passes over the cluster: a pass sums the Gram
matrix of the rows as they are so far, the driver takes its Cholesky factor (the first
Gram matrix, and each that has no factor, is shifted by a multiple of the identity
first), and later passes put the rows through the triangular solves of all factors.
The product of the factors is the R of the centred rows; its singular values and right
vectors are the scales and components. A covariance matrix is never decomposed, so a
small component keeps its digits beside a large one.

The driver sees sums over all rows only: one per dimension, one per pair of dimensions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import shared, written

#: An entry c becomes floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Passes at most, and the largest entry of Gram matrix minus identity that ends them.
PASSES, SETTLED = 8, 1e-11
#: Directions whose scale is below this share of the largest one count as absent.
LEAST_SCALE = 1e-9
#: Entries of a block of rows that are worked on together.
BLOCK = 1 << 18
WHITE = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Whitening:
    """What a row needs: counts and sums, components (one per column), eigenvalues."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float = 0.0
    passes: int = 0

    def project(self, rows: np.ndarray) -> np.ndarray:
        return rows @ self.components / np.sqrt(self.eigenvalues)


def integer_vectors(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, x`` of the rows that take part, other columns left out.

    Vectors that are null, empty or hold a null or non-finite entry take no part, nor do
    vectors of another length than the most frequent one (the longer, if two are).
    """
    given = F.col(embedding).cast("array<double>")
    finite = F.forall(given, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    whole = F.transform(given, lambda v: F.floor(SCALE * v) + F.lit(OFFSET).cast("long"))
    kept = table.where(F.col(embedding).isNotNull() & (F.size(embedding) > 0) & finite)
    kept = kept.select(F.col(vec_id).cast("long").alias("vec_id"), whole.alias("x"))
    lengths = kept.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return kept.where(F.size("x") == (lengths[0]["d"] if lengths else 0))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Pieces of the batches with their rows as a matrix of integers."""
    for batch in batches:
        if batch.num_rows:
            x = batch.column("x")
            step = max(1, BLOCK // len(x[0]))
            for low in range(0, batch.num_rows, step):
                piece = batch.slice(low, step)
                rows = piece.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                yield piece, rows.reshape(piece.num_rows, -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per dimension: number of rows, sum, least and greatest entry."""
    n, total, low, high = 0, 0, None, None
    for _, x in _blocks(batches):
        n, total = n + len(x), total + x.sum(axis=0)
        low = x.min(axis=0) if low is None else np.minimum(low, x.min(axis=0))
        high = x.max(axis=0) if high is None else np.maximum(high, x.max(axis=0))
    if n:
        columns = [np.arange(len(total)), np.full(len(total), n), total, low, high]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["i", "n", "s", "low", "high"])


def _totals(fit: DataFrame) -> tuple[int, np.ndarray]:
    """Number of rows and exact sums per dimension."""
    parts = fit.mapInArrow(_sums, "i long, n long, s long, low long, high long")
    merged = [F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("low").alias("low"), F.max("high").alias("high")]
    found = parts.groupBy("i").agg(*merged).orderBy("i").collect()
    n = found[0]["n"] if found else 0
    if n and n * max(r["high"] - r["low"] + 1 for r in found) >= 1 << 62:
        raise ArithmeticError("entries spread too far for exact 64-bit deviations")
    return n, np.array([r["s"] for r in found], dtype=np.int64)


def _scaled(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, exact: the quotient of S goes off first, so that products stay small."""
    whole, rest = np.divmod(sums, n)
    return (x - whole) * n - rest


def solve_rows(rows: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """The rows q with q @ upper = row, column after column."""
    out = np.empty_like(rows)
    for j in range(upper.shape[0]):
        out[:, j] = (rows[:, j] - out[:, :j] @ upper[:j, j]) / upper[j, j]
    return out


def _gram(fit: DataFrame, n: int, sums: np.ndarray, step: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sum over the fit list of the outer products of what ``step`` makes of a centred row."""
    upper = np.triu_indices(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for _, x in _blocks(batches):
            rows = step(_scaled(x, n, sums) / n)
            total += rows.T @ rows
        yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int64)) for c in upper), pa.array(total[upper])], ["i", "j", "g"])

    parts = fit.mapInArrow(run, "i long, j long, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).toArrow()
    i, j, g = (parts[c].to_numpy() for c in ("i", "j", "g"))
    out = np.zeros((size, size))
    out[i, j], out[j, i] = g, g
    return out


def _factor(gram: np.ndarray, n: int, shifted: bool) -> np.ndarray:
    """Upper Cholesky factor; the shift makes up for the rounding of a Gram matrix of n rows."""
    d = len(gram)
    if not shifted:
        try:
            return np.linalg.cholesky(gram).T
        except np.linalg.LinAlgError:
            pass
    shift = 11 * (n * d + d * (d + 1)) * np.finfo(float).eps / 2 * np.linalg.norm(gram, 2)
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift *= 10


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Learn from each distinct ``x`` of ``vectors`` once; None if all are the same or none is.

    There are as many components as directions in which the rows differ, ``components``
    at most, by falling eigenvalue; the largest entry of each is positive.
    """
    fit = written(vectors.select("x").distinct(), "fit")
    n, sums = _totals(fit)
    d = len(sums)
    factors: list[np.ndarray] = []
    composed = np.eye(d)

    def solved(rows: np.ndarray) -> np.ndarray:
        for factor in factors:
            rows = solve_rows(rows, factor)
        return rows

    for turn in range(PASSES):
        gram = _gram(fit, n, sums, solved, d) if n else np.zeros((0, 0))
        if not gram.any():
            return None
        if turn and np.abs(gram - np.eye(d)).max() < SETTLED:
            break
        factors.append(_factor(gram, n, shifted=turn == 0))
        composed = factors[-1] @ composed
    scales, right = np.linalg.svd(composed)[1:]
    values = scales**2 / n
    kept = min(components, int((scales > LEAST_SCALE * scales[0]).sum()))
    axes = right[:kept].T
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(kept)])
    model = Whitening(n, sums, axes, values[:kept], float(values.sum()), passes=len(factors))
    covariance = _gram(fit, n, sums, model.project, kept) / n
    return replace(model, identity_error=float(np.abs(covariance - np.eye(kept)).max()))


def _deviations(scaled: np.ndarray) -> list[int | None]:
    """Sum of squares per row, exact; None beyond 64 bits."""
    if float(np.abs(scaled).max(initial=0)) ** 2 * scaled.shape[1] < 2**62:
        return (scaled * scaled).sum(axis=1).tolist()
    exact = (sum(int(v) * int(v) for v in row) for row in scaled)
    return [v if v < 1 << 63 else None for v in exact]


def whiten(
    table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """One row per vector that takes part and component: ``vec_id, component, n, deviation,
    whitened, explained, identity_error``.

    Which vectors take part is said at :func:`integer_vectors`. Repeated rows and rows
    without an id come out as often as they go in, but copies count once in what is
    learned. Vectors that are all the same have no component and give no row, nor does an
    empty table. Other columns are ignored. ``deviation`` is null beyond 64 bits.
    """
    vectors = integer_vectors(table, vec_id, embedding)
    model = fit_whitening(vectors, components)
    if model is None:
        return table.sparkSession.createDataFrame([], WHITE)
    held = shared(table.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        k = len(model.eigenvalues)
        share = model.eigenvalues / model.trace
        for piece, x in _blocks(batches):
            scaled = _scaled(x, model.n, model.sums)
            rows = len(x)
            each = np.repeat(np.arange(rows), k)
            columns = [
                piece.column("vec_id").take(pa.array(each)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * k, model.n, dtype=np.int64)),
                pa.array(_deviations(scaled), pa.int64()).take(pa.array(each)),
                pa.array(model.project(scaled / model.n).ravel()),
                pa.array(np.tile(share, rows)),
                pa.array(np.full(rows * k, model.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in WHITE.split(", ")])

    return vectors.mapInArrow(run, WHITE)

