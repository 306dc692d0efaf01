"""Functions of groups of rows, many small groups to a task.

``applyInPandas`` builds a table for each group, some milliseconds each, which is most of the work where groups are
windows of a few rows. Here a task gets its groups sorted, one after the other, and cuts batches of rows where keys change.
``applied`` calls a function for each group; ``together`` gives it all groups of a batch at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

ARROW = {"double": pa.float64(), "float": pa.float32(), "long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string(), "boolean": pa.bool_(), "date": pa.date32()}


def changes(rows: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Of each row but the first, whether its keys differ from those of the row before; NULLs are equal, and so are NaNs."""
    n, out = rows.num_rows, np.zeros(max(rows.num_rows - 1, 0), bool)
    for k in keys if n > 1 else ():
        a, b = rows.column(k).slice(0, n - 1), rows.column(k).slice(1)
        differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        if pa.types.is_floating(a.type):
            differ = pc.and_not(differ, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
        out |= differ.to_numpy(zero_copy_only=False)
    return out


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def together(df: DataFrame, keys: list[str], order: list[str], each: Callable[[pa.RecordBatch, np.ndarray], tuple], found: dict[str, str], tasks: int | None = None) -> DataFrame:
    """keys and the columns ``found`` (name: type): what ``each`` makes of whole groups of equal ``keys``, many at once, in ``order``.

    ``each`` gets rows of one or more groups and where each begins, and gives how many rows each group has in what it
    made, and a list of columns, one for each of ``found``. A task holds one group and one batch of rows.
    """

    def of(rows: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        lengths, made = each(rows, starts)
        at = pa.array(np.repeat(starts, lengths))
        return pa.record_batch([*[rows.column(k).take(at) for k in keys], *[pa.array(v, ARROW[t]) for v, t in zip(made, found.values(), strict=True)]], [*keys, *found])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []  # of the group that may go on
        for b in batches:
            if not b.num_rows:
                continue
            starts = np.flatnonzero(changes(b, keys)) + 1
            if waiting and changes(_joined([waiting[-1].slice(waiting[-1].num_rows - 1), b.slice(0, 1)]), keys)[0]:
                starts = np.append(0, starts)
            if len(starts):
                if waiting or starts[0]:
                    yield of(_joined([*waiting, *([b.slice(0, starts[0])] if starts[0] else [])]), np.zeros(1, int))
                whole = b.slice(starts[0], starts[-1] - starts[0])
                if whole.num_rows:
                    yield of(whole, starts[:-1] - starts[0])
                waiting = []
                b = b.slice(starts[-1])
            waiting.append(b)
        if waiting:
            yield of(_joined(waiting), np.zeros(1, int))

    types = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + "".join(f", `{c}` {t}" for c, t in found.items())
    dealt = df.repartition(tasks, *keys) if tasks else df.repartition(*keys)
    return dealt.sortWithinPartitions(*keys, *order).mapInArrow(parts, schema)


def applied(df: DataFrame, keys: list[str], order: list[str], each: Callable[..., list], found: dict[str, str], tasks: int | None = None) -> DataFrame:
    """keys and the columns ``found`` (name: type): what ``each`` makes of the rows with equal ``keys``, in ``order``.

    ``each`` gets all other columns by name, as arrays, and gives a list of columns, one for each of ``found``. A task
    holds one group and one batch of rows. ``tasks`` is their number where groups are few and long to work on.
    """
    names = [c for c in df.columns if c not in keys]

    def one_by_one(rows: pa.RecordBatch, starts: np.ndarray) -> tuple:
        columns = [rows.column(c).to_numpy(zero_copy_only=False) for c in names]
        lengths, out = [], [[] for _ in found]
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), rows.num_rows], strict=True):
            made = each(**{c: v[a:b] for c, v in zip(names, columns, strict=True)})
            lengths.append(len(made[0]))
            for own, column in zip(out, made, strict=True):
                own.extend(column)
        return lengths, out

    return together(df, keys, order, one_by_one, found, tasks)
