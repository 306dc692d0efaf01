"""What the operators of this subpackage share: the shared folder, row numbers, bounded Arrow batches, text rules."""

from __future__ import annotations

import gc
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Rows that a function is given at once.
BATCH_ROWS = 256

#: Row numbers are broadcast up to this many (8 bytes each, 8 MB); beyond it a join shuffles both sides.
BROADCAST_ROWS = 1_000_000

#: Entries of some columns are broadcast up to this many (about 100 bytes each).
BROADCAST_ENTRIES = 100_000

#: A key with more rows than this is hot: its entry is broadcast, of which there are so few as the rows allow.
HOT_ROWS = 200_000


def is_local(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


_temporary: dict[str, str] = {}


def own_folder(spark: SparkSession) -> str:
    """This application's part of the folder that driver and executors share (``spark.checkpoint.dir``).

    Where the setting is absent, a temporary folder takes its place if all runs in one process (a local master); on a
    cluster that is an error, since executors have other disks.
    """
    base, name = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if not base:
        if not is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _temporary.setdefault(name, "") or tempfile.mkdtemp(prefix="tidewave-")
        _temporary[name] = base
    return f"{base.rstrip('/')}/tidewave-{name}"


#: The folder of the tables that are stored now, if not the application's: of this thread alone.
_writing_to: ContextVar[str | None] = ContextVar("writing_to", default=None)


def shared_folder(spark: SparkSession) -> str:
    """A new path for a table: in ``own_folder``, or in the folder that ``writing_to`` names."""
    return f"{_writing_to.get() or own_folder(spark)}/{uuid.uuid4().hex}"


@contextmanager
def writing_to(folder: str) -> Iterator[None]:
    """Tables stored inside go to ``folder``."""
    before = _writing_to.set(folder)
    try:
        yield
    finally:
        _writing_to.reset(before)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables stored inside are deleted at the end, but for those that the function it gives has stored. Nothing else made inside may be used after it."""
    folder, outside = shared_folder(spark), _writing_to.get() or own_folder(spark)

    def kept(df: DataFrame) -> DataFrame:
        with writing_to(outside):
            return stored(df)

    try:
        with writing_to(folder):
            yield kept
    finally:
        release(spark, folder)


def release(spark: SparkSession, folder: str | None = None) -> None:
    """Delete ``folder``, or all tables that this application has stored in the shared folder: once the results are written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder or own_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of what nothing refers to any more: it does so only when the driver collects garbage, which a large heap may put off for long."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again: the lineage ends here, and a lost executor costs no earlier stage."""
    spark = df.sparkSession
    path = path or shared_folder(spark)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else. ``lower`` does the same to a text of ASCII alone and is much faster than ``translate``."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def documents(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and a row number; other columns, whatever their names, go no further.

    ``row`` tells rows with equal doc_id apart. It holds for one scan only: two scans may split their files in different
    ways. So what uses it is written once, and all else is derived from that table.
    """
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def numbered(docs: DataFrame, *more: Column) -> DataFrame:
    """row, doc_id, text (null: empty) and ``doc``, the struct of all columns, whatever their names: written once, so that ``row`` is the same in all that follows.

    ``more`` are expressions on fields of ``doc``.
    """
    written = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")))
    return written.select("row", F.col("doc.doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc.text").cast("string"), F.lit("")).alias("text"), *more, "doc")


def sent_if_small(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``rows``, a stored table, to be broadcast up to ``most`` rows: a join with it then moves no texts."""
    return F.broadcast(rows) if rows.count() <= most else rows


def without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """The documents of ``rows`` (from ``numbered``), with their own columns, but for the row numbers of ``dropped``, a stored table."""
    return rows.join(sent_if_small(dropped.select("row")), "row", "left_anti").select("doc.*")


def looked_up(rows: DataFrame, entries: DataFrame, on: list[str], n: str, how: str = "inner", hot: int = HOT_ROWS, size: int | None = None, few: int = BROADCAST_ENTRIES) -> DataFrame:
    """``rows`` joined with ``entries``, a stored table of one row for each key with the number ``n`` of rows that have it.

    A few entries are broadcast. Of more, those of keys with more than ``hot`` rows are broadcast: there are at most the
    number of rows by ``hot`` of them. So no task gets all rows of a hot key. All other keys meet in a plain join.
    ``how`` is inner or left; ``size`` is the number of entries, where it is known; up to ``few`` are few, more of them where they are two numbers each.
    """
    if (entries.count() if size is None else size) <= few:
        return rows.join(F.broadcast(entries), on, how)
    often = entries.where(F.col(n) > hot)
    if often.isEmpty():
        return rows.join(entries, on, how)
    keys = F.broadcast(often.select(*on))
    return rows.join(F.broadcast(often), on).unionByName(rows.join(keys, on, "left_anti").join(entries.where(F.col(n) <= hot), on, how))


#: Cells of counts, by their logarithm, and of values within one, in which the cut between frequent and rare rows is looked for.
LOG_CELLS, FINE_CELLS = 8, 1_024


def counted_cells(rows: DataFrame, cell: Column) -> dict[int, int]:
    """How many rows are in each cell; cells are few."""
    return {r["c"]: r["rows"] for r in rows.groupBy(cell.cast("long").alias("c")).agg(F.count("*").alias("rows")).collect()}


def most_frequent(counted: DataFrame, n: str, most: int) -> DataFrame:
    """The ``most`` rows of ``counted``, a stored table, with the highest ``n`` (a whole number from 1); of those that tie for the last places, some by a hash.

    Rows are counted in cells of the logarithm of n, then the cell where the cut falls is cut into finer ones until it
    is one value; its rows are cut by their hash in the same way. No task or driver sorts the rows, and however many
    rows are common, ``most`` are found but for a share of equal hashes.
    """

    def cut(rows: DataFrame, cell: Column, room: int) -> tuple[int | None, int]:
        """The cell that holds the cut, if not all rows have room, and how much room is left in it."""
        held = counted_cells(rows, cell)
        for c in sorted(held, reverse=True):
            if held[c] > room:
                return c, room
            room -= held[c]
        return None, room

    value = F.col(n)
    log = F.floor(F.log2(value.cast("double")) * LOG_CELLS)
    at, room = cut(counted, log, most)
    if at is None:
        return counted
    inside = counted.where(log == at)
    ends = inside.agg(F.min(n).alias("low"), F.max(n).alias("high")).first()
    low, high = ends["low"], ends["high"]
    while low < high:
        width = -(-(high - low + 1) // FINE_CELLS)
        fine, room = cut(inside.where(value.between(low, high)), F.floor((value - low) / F.lit(width)), room)
        low, high = low + fine * width, min(high, low + fine * width + width - 1)
    above = counted.where(value > low)
    ties, hashed = counted.where(value == low), F.xxhash64(*[F.col(f"`{c}`") for c in counted.columns])
    low, high = -(1 << 63), (1 << 63) - 1
    place = hashed.cast("decimal(20,0)")
    while room and low < high:
        width = -(-(high - low + 1) // FINE_CELLS)
        found, left = cut(ties.where(place.between(low, high)), F.floor((place - F.lit(low).cast("decimal(20,0)")) / F.lit(width).cast("decimal(20,0)")), room)
        if found is None:
            break
        room, low, high = left, low + found * width, min(high, low + found * width + width - 1)
    return above.unionByName(ties.where(place > high))


def map_batches(df: DataFrame, each: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with batches of at most ``BATCH_ROWS`` rows.

    Spark ends a batch at 64 MB (``spark.sql.execution.arrow.maxBytesPerBatch``); what a function makes of a batch of
    short texts is bounded by the number of rows.
    """

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, max(b.num_rows, 1), BATCH_ROWS):
                yield b.slice(at, BATCH_ROWS)

    return df.mapInArrow(lambda batches: each(bounded(batches)), schema)


#: Arrays of tasks are added up in so many tasks before one adds the rest.
SUM_TASKS = 16


def added(rows: DataFrame, arrays_of: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], plus: Callable[[np.ndarray, np.ndarray], np.ndarray] = np.add, last: Callable[[np.ndarray], np.ndarray] | None = None) -> np.ndarray | None:
    """The sum, by ``plus``, of the arrays that ``arrays_of`` makes of each task's batches: within a task, then in ``SUM_TASKS`` tasks, then in one. None if there are none.

    What moves is one array for each task, compressed; the driver is sent one, or what ``last`` makes of it.
    """

    def total(arrays: Iterator[np.ndarray], last: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[pa.RecordBatch]:
        out = None
        for a in arrays:
            if out is None:
                out = a
            elif out.shape != a.shape:
                raise ValueError(f"arrays of {out.shape} and {a.shape}: vectors have different lengths")
            else:
                out = plus(out, a)
        if out is not None:
            out = last(out) if last else out
            data = pa.compress(out.tobytes(), codec="zstd", asbytes=True)
            yield pa.record_batch([pa.array([data], pa.binary()), pa.array([out.dtype.str]), pa.array([list(out.shape)], pa.list_(pa.int32()))], ["sum", "kind", "shape"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for b in batches:
            for r in b.to_pylist():
                size = math.prod(r["shape"]) * np.dtype(r["kind"]).itemsize
                yield np.frombuffer(pa.decompress(r["sum"], size, codec="zstd", asbytes=True), r["kind"]).reshape(r["shape"])

    schema = "sum binary, kind string, shape array<int>"
    first = map_batches(rows, lambda batches: total(arrays_of(batches)), schema)
    few = first.repartition(SUM_TASKS).mapInArrow(lambda batches: total(sums(batches)), schema)
    one = few.repartition(1).mapInArrow(lambda batches: total(sums(batches), last), schema)  # SUM_TASKS arrays, one at a time
    return next(sums(iter(one.toArrow().to_batches())), None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
