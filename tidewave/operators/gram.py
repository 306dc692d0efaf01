"""Sums of products of all pairs of columns at once, as blocks of X'X that tasks add up: for hundreds of columns.

An aggregate for each pair of 415 columns would be 85,905 expressions; a task's block is one product of matrices.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Blocks of tasks are added up in so many tasks before the driver adds the rest.
SUM_TASKS = 16

#: A block is four times the columns squared doubles: 128 MB at most.
MOST_COLUMNS = 2_000

#: Rows that are multiplied at once.
ROWS_AT_ONCE = 4_096


@dataclass
class Moments:
    """Of columns: means where known, and, for each pair, how many rows know both and the sums over these of x less its mean and of products of such; ``sums[i, j]`` is of column i where j is known."""

    columns: list[str]
    means: np.ndarray
    counts: np.ndarray
    sums: np.ndarray
    products: np.ndarray

    def variances(self) -> np.ndarray:
        """Population variances; NaN without values."""
        n = np.diag(self.counts)
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.diag(self.products) / n - (np.diag(self.sums) / n) ** 2

    def covariances(self) -> np.ndarray:
        """Population covariances over the rows that know both columns."""
        with np.errstate(invalid="ignore", divide="ignore"):
            return self.products / self.counts - self.sums / self.counts * (self.sums.T / self.counts)

    def correlations(self) -> np.ndarray:
        """Covariances by the columns' own deviations; NaN where one doesn't vary."""
        sd = np.sqrt(np.maximum(self.variances(), 0))
        with np.errstate(invalid="ignore", divide="ignore"):
            return self.covariances() / np.outer(sd, sd)


def _added(df: DataFrame, block: int, of: callable) -> np.ndarray:
    """The sum of ``of`` (rows of known values, NaN for others) over all rows: one array of ``block`` doubles a task, then of ``SUM_TASKS``."""

    def out(total: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        if total is not None:
            yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["sum"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for at in range(0, b.num_rows, ROWS_AT_ONCE):
                part = b.slice(at, ROWS_AT_ONCE)
                x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in part.columns])
                own = of(np.where(np.isfinite(x), x, np.nan)).ravel()
                total = own if total is None else total + own
        yield from out(total)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for s in b.column("sum"):
                own = np.frombuffer(s.as_buffer(), float)
                total = own if total is None else total + own
        yield from out(total)

    few = df.mapInArrow(first, "sum binary").repartition(SUM_TASKS).mapInArrow(again, "sum binary")
    return sum((np.frombuffer(r["sum"], float) for r in few.collect()), np.zeros(block))  # at most SUM_TASKS blocks


def moments(df: DataFrame, columns: list[str]) -> Moments:
    """``Moments`` of numeric columns, in two passes: means, then products of what is left of each value. NULLs, NaN and infinities are unknown.

    Nothing is shuffled but one block for each task.
    """
    if len(columns) > MOST_COLUMNS:
        raise ValueError(f"{len(columns)} columns are more than {MOST_COLUMNS}")
    k, rows = len(columns), df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    totals = _added(rows, 2 * k, lambda x: np.stack([np.nansum(x, axis=0), (~np.isnan(x)).sum(axis=0)])).reshape(2, k)
    means = totals[0] / np.maximum(totals[1], 1)

    def products(x: np.ndarray) -> np.ndarray:
        known = (~np.isnan(x)).astype(float)
        left = np.where(known > 0, x - means, 0.0)
        return np.stack([known.T @ known, left.T @ known, left.T @ left])

    counts, sums, crossed = _added(rows, 3 * k * k, products).reshape(3, k, k)
    return Moments(list(columns), means, counts, sums, crossed)


def correlated_columns(df: DataFrame, columns: list[str], least_variance: float, most_r: float) -> DataFrame:
    """column, variance, kept: columns of too little variance go, and of each pair correlated beyond ``most_r`` the earlier one.

    A column without values has no variance (NULL) and goes. The driver holds the matrix of the columns alone.
    """
    found = moments(df, columns)
    variance = found.variances()
    varied = np.nan_to_num(variance, nan=-1.0) > least_variance
    near = np.triu(np.abs(np.nan_to_num(found.correlations())) >= most_r, 1) & varied[None, :]
    kept = varied & ~near.any(axis=1)
    rows = [(c, None if np.isnan(v) else float(v), bool(k)) for c, v, k in zip(columns, variance, kept, strict=True)]
    return df.sparkSession.createDataFrame(rows, "column string, variance double, kept boolean")
