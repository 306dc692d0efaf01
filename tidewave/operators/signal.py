"""Zero-phase filters, whose recursion has no relational form, in Arrow batches of whole blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import slices


def butterworth(order: int, cutoff: float, rate: float, high: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Low-pass coefficients b, a by the bilinear transform, or those of a high-pass."""
    warped = 2 * rate * np.tan(np.pi * cutoff / rate)
    poles = warped * np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    if high:
        poles = warped * warped / poles
    z = (2 * rate + poles) / (2 * rate - poles)
    a = np.real(np.poly(z))
    b = np.real(np.poly(np.ones(order) if high else -np.ones(order)))
    at = (-1.0) ** np.arange(order + 1) if high else np.ones(order + 1)  # where the gain is one
    return b * (a @ at) / (b @ at), a


def run_filter(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Each row of ``x`` filtered from its ``state``; a step takes one sample of all rows."""
    out = np.empty_like(x)
    for i in range(x.shape[1]):
        v = x[:, i, None]
        y = b[0] * v + state[:, :1]
        state = np.concatenate([state[:, 1:], np.zeros_like(y)], axis=1) + b[1:] * v - a[1:] * y
        out[:, i] = y[:, 0]
    return out


def zero_phase(segments: list[np.ndarray], b: np.ndarray, a: np.ndarray) -> list[np.ndarray]:
    """Each segment forward and backward, with odd extension at the ends and a start in the steady state; short ones stay as they are.

    Segments of like lengths are the rows of one table.
    """
    pad = 3 * max(len(a), len(b))
    n = len(a) - 1
    companion = np.zeros((n, n))
    companion[:, 0], companion[np.arange(n - 1), np.arange(1, n)] = -a[1:], 1
    steady = np.linalg.solve(np.eye(n) - companion, b[1:] - a[1:] * b[0])
    out, alike = list(segments), {}
    for i, x in enumerate(segments):
        if len(x) > pad:
            alike.setdefault(len(x).bit_length(), []).append(i)
    for rows in alike.values():
        wide = [np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]) for x in (segments[i] for i in rows)]
        ends = np.array([len(x) for x in wide])
        table = np.stack([np.pad(x, (0, ends.max() - len(x))) for x in wide])
        at = ends[:, None] - 1 - np.arange(ends.max())  # each row's own part backward; what lies behind it has no effect
        back = np.where(at >= 0, at, 0)
        for _ in range(2):
            table = np.take_along_axis(run_filter(b, a, table, steady * table[:, :1]), back, axis=1)
        for i, x, end in zip(rows, table, ends, strict=True):
            out[i] = x[pad : end - pad]
    return out


def memory(a: np.ndarray) -> int:
    """Samples after which the filter has forgotten what came before, to 1e-13."""
    slowest = min(float(np.abs(np.roots(a)).max()), 1 - 1e-6)
    return int(np.ceil(np.log(1e-13) / np.log(slowest))) + len(a)


#: Samples that a block gives results for.
BLOCK = 4_096


def low_pass(df: DataFrame, key: str, order_by: list[str], x: str, cutoff: float, rate: float, order: int = 4, block: int = BLOCK, width: float | None = None, slice_rows: int = slices.SLICE_ROWS, high: bool = False) -> DataFrame:
    """``df``'s key and order columns, x and ``<x>_smooth``: each segment without NULLs is filtered on its own.

    Segments are cut into blocks, with as many samples around each as the filter remembers, so a task holds one block,
    however long a recording is, and blocks give what the whole segment gives. Samples without a value have no result.
    Segments are told apart over each recording's rows in order, or, with ``width``, a stretch of the first column of
    ``order_by``, over slices of them. ``high`` passes what is faster instead.
    """
    b, a = butterworth(order, cutoff, rate, high)
    around = memory(a)
    ok = F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))
    marked = df.select(key, *order_by, x).withColumn("__ok", ok)
    if width is None:
        part, own = Window.partitionBy(key).orderBy(*order_by), Window.partitionBy(key, "__segment")
        new = F.coalesce(F.col("__ok") != F.lag("__ok").over(part), F.lit(True)).cast("int")
        numbered = marked.withColumn("__new", new).withColumn("__segment", F.sum("__new").over(part.rowsBetween(Window.unboundedPreceding, 0)))
        placed = numbered.withColumns({"__at": F.row_number().over(own.orderBy(*order_by)) - 1, "__of": F.count("*").over(own)})
    else:
        placed = slices.segments(slices.framed(marked, [key], order_by[0], order_by, width), "__ok", [key], slice_rows)
    last = F.floor((F.col("__of") - 1) / block)
    first = F.greatest(F.lit(0), F.floor((F.col("__at") - around) / F.lit(block)))
    blocks = F.sequence(first.cast("int"), F.least(last, F.floor((F.col("__at") + around) / F.lit(block))).cast("int"))
    dealt = placed.where("__ok").withColumn("__block", F.explode(blocks))

    own_block = [key, "__segment", "__block"]

    def results(pdf: pd.DataFrame) -> pd.DataFrame:
        edges = np.flatnonzero((pdf[own_block] != pdf[own_block].shift()).any(axis=1))
        parts = np.split(pdf[x].to_numpy(float), edges[1:])
        pdf = pdf.assign(**{f"{x}_smooth": np.concatenate(zero_phase(parts, b, a))})
        return pdf[pdf["__at"] // block == pdf["__block"]][[*columns, f"{x}_smooth"]]

    def smooth(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the block that may go on in the next batch
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            last = (pdf[own_block] != pdf[own_block].iloc[-1]).any(axis=1).sum() if len(pdf) else 0
            if last:
                yield results(pdf.iloc[:last])
            held = pdf.iloc[last:]
        if held is not None and len(held):
            yield results(held)

    columns = [key, *order_by, x]
    types = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in columns) + f", `{x}_smooth` double"
    filtered = dealt.repartition(*own_block).sortWithinPartitions(*own_block, "__at").mapInPandas(smooth, schema)
    return filtered.unionByName(marked.where("not __ok").select(*columns, F.lit(None).cast("double").alias(f"{x}_smooth")))
