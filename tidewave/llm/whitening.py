"""Whitening of embeddings by shifted CholeskyQR.

Vectors become whole numbers, and a first pass sums them exactly, so that rows can be centred before anything is
multiplied. Then Gram passes: each task orthogonalises its centred rows by triangular solves with the factors found so
far and returns one sum of products; the sums are added up in a few tasks more. Cholesky's factor of the first Gram
matrix, shifted so that it exists whatever the condition, of the second and of the third make up R. What the third pass
still finds is taken by its eigenvectors, so that directions without any variance fall out there. The singular values of
R, which is small, give the components. Vectors never move: every pass is a scan, and a pass is repeated from the table
where an executor is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import added, map_batches

#: A sum is dimensions squared doubles, which a task and the driver hold some times: 128 MB here.
MOST_DIMENSIONS = 4_096

#: Columns that a triangular solve takes at once.
SOLVE_COLUMNS = 32

#: Squared singular values of orthogonalised rows under this have no variance behind them but that of rounding.
NO_VARIANCE = 1e-6


def whole_numbers(vectors: pa.ListArray, scale: float, offset: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * c) + offset of the vectors that aren't null and hold neither nulls nor entries that aren't finite, and which these are."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    held = np.flatnonzero(~np.isnan(lengths.astype(float)))
    width = int(lengths[held[0]]) if len(held) else 0
    if (lengths[held] != width).any():
        raise ValueError("vectors have different lengths")
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(held), width)
    fine = np.isfinite(values).all(axis=1)
    scaled = np.floor(scale * values[fine])
    if np.abs(scaled).max(initial=0) >= 2.0**53:
        raise OverflowError(f"an entry times {scale:g} doesn't fit 53 bits")
    return scaled.astype(np.int64) + offset, held[fine]


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums: the whole numbers that are n times the centred rows."""
    if n * float(np.abs(x).max(initial=0)) >= 2.0**62:
        raise OverflowError(f"{n} times an entry doesn't fit 64 bits")
    return n * x - sums


def solved(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """rows times the inverse of the upper triangular ``factor``, by forward substitution, block for block of columns."""
    out = np.empty_like(rows)
    for at in range(0, rows.shape[1], SOLVE_COLUMNS):
        own = slice(at, at + SOLVE_COLUMNS)
        rest = rows[:, own] - out[:, :at] @ factor[:at, own]
        out[:, own] = np.linalg.solve(factor[own, own].T, rest.T).T
    return out


def summed(rows: DataFrame, each: Callable[[pa.RecordBatch], np.ndarray | None]) -> np.ndarray | None:
    """The sum of ``each`` (batch) over all rows; None if there is none."""
    return added(rows, lambda batches: (a for b in batches if (a := each(b)) is not None))


def shift_of(gram: np.ndarray, n: int) -> float:
    """What makes Cholesky's factor of ``gram`` exist in spite of rounding."""
    d = len(gram)
    return 11 * (n * d + d * (d + 1)) * np.finfo(float).eps / 2 * float(np.linalg.norm(gram, 2))


def next_factor(gram: np.ndarray, n: int, first: bool) -> np.ndarray:
    """The upper factor of ``gram``, shifted at first, and again if rows are still too far from orthogonal."""
    values = np.linalg.eigvalsh(gram)
    shifted = first or values[0] <= NO_VARIANCE * values[-1]
    return np.linalg.cholesky(gram + shift_of(gram, n) * np.eye(len(gram)) * shifted).T


class Fit:
    """Components (columns), their eigenvalues and the trace of the covariance of ``n`` vectors with sums ``sums``."""

    def __init__(self, n: int, sums: np.ndarray, factor: np.ndarray, most: int):
        _, singular, right = np.linalg.svd(factor)
        values = singular**2 / n
        self.n, self.sums, self.trace = n, sums, float(values.sum())
        k = min(most, int((singular > 0).sum()))
        vectors = right[:k].T
        signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)])
        self.values, self.vectors = values[:k], vectors * signs  # the largest entry is positive

    def whitened(self, wide: np.ndarray) -> np.ndarray:
        """Of rows of ``centred``."""
        return wide / self.n @ self.vectors / np.sqrt(self.values)


def fit(embeddings: DataFrame, vector: str = "embedding", most: int = 8, scale: float = 1024.0, offset: int = 100_000) -> Fit | None:
    """The ``most`` components of most variance over all vectors; None if no vector is left.

    There are fewer where fewer directions vary.
    """
    rows = embeddings.select(F.col(f"`{vector}`").alias("v"))

    def numbers(batch: pa.RecordBatch) -> np.ndarray:
        return whole_numbers(batch.column("v"), scale, offset)[0]

    def counted(batch: pa.RecordBatch) -> np.ndarray | None:
        x = numbers(batch)
        return np.append(x.sum(axis=0), len(x)) if len(x) else None

    totals = summed(rows, counted)
    if totals is None:
        return None
    n, sums = int(totals[-1]), totals[:-1]
    if len(sums) > MOST_DIMENSIONS:
        raise ValueError(f"vectors have {len(sums)} entries, more than {MOST_DIMENSIONS}")
    factors: list[np.ndarray] = []

    def gram_of(factors: list[np.ndarray]) -> np.ndarray:
        def each(batch: pa.RecordBatch) -> np.ndarray | None:
            x = numbers(batch)
            if not len(x):
                return None
            q = centred(x, n, sums) / n
            for factor in factors:
                q = solved(q, factor)
            return q.T @ q

        return summed(rows, each)

    for nth in range(2):
        gram = gram_of(factors)
        if not gram.any():  # nothing varies
            return Fit(n, sums, np.zeros_like(gram), most)
        factors.append(next_factor(gram, n, first=nth == 0))
    values, vectors = np.linalg.eigh(gram_of(factors))
    varied = values > NO_VARIANCE * values[-1]
    factor = np.sqrt(values[varied])[:, None] * vectors[:, varied].T
    for own in reversed(factors):
        factor = factor @ own
    return Fit(n, sums, factor, most)


def identity_error(embeddings: DataFrame, found: Fit, vector: str = "embedding", scale: float = 1024.0, offset: int = 100_000) -> float:
    """The largest entry, in size, of the covariance of all whitened vectors less the identity."""

    def each(batch: pa.RecordBatch) -> np.ndarray | None:
        x, _ = whole_numbers(batch.column("v"), scale, offset)
        y = found.whitened(centred(x, found.n, found.sums))
        return np.vstack([y.T @ y, y.sum(axis=0)]) if len(x) else None

    total = summed(embeddings.select(F.col(f"`{vector}`").alias("v")), each)
    mean = total[-1] / found.n
    return float(np.abs(total[:-1] / found.n - np.outer(mean, mean) - np.eye(len(mean))).max())


SCHEMA = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, vector: str = "embedding", most: int = 8, scale: float = 1024.0, offset: int = 100_000) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each row whose vector takes part and each of the first ``most`` components.

    Entries become floor(scale * c) + offset, exactly. Rows whose vector is null or holds a null or an entry that isn't
    finite take no part; rows that repeat, or whose vec_id is null, do. deviation is the sum over dimensions of
    (n * x - sum) squared, exact; explained is the component's share of the variance. Components have their largest
    entry positive. Directions in which nothing varies are no components, so a table of equal vectors gives no rows, and
    neither does an empty one. Vectors of different lengths, and numbers whose multiples don't fit 64 bits, are an error. Other
    columns are ignored. The vectors are read once for each of the six passes.
    """
    found = fit(embeddings, vector, most, scale, offset)
    if found is None or not len(found.values):
        return embeddings.sparkSession.createDataFrame([], SCHEMA)
    error = identity_error(embeddings, found, vector, scale, offset)
    k, explained = len(found.values), found.values / found.trace

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, at = whole_numbers(b.column("v"), scale, offset)
            wide = centred(x, found.n, found.sums)
            small = (wide.astype(float) ** 2).sum(axis=1).max(initial=0) < 2.0**62
            deviation = pa.array(((wide if small else wide.astype(object)) ** 2).sum(axis=1).tolist(), pa.decimal128(38, 0))
            m = len(x)
            yield pa.record_batch(
                [
                    b.column("vec_id").take(pa.array(np.repeat(at, k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, found.n)),
                    deviation.take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(found.whitened(wide).ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return map_batches(embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(f"`{vector}`").alias("v")), each, SCHEMA)
