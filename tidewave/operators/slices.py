"""Ordered functions over recordings of any length, without a task that holds one whole.

Rows get their place in the recording (``frame``) from counts of stretches of time. By it a recording is cut into slices
of so many rows, and each slice is given as many rows of its neighbours as a function looks back and ahead; then any
window function by slice gives what it gives by recording. What runs through a whole recording, a running count or the
last known value, is worked out in each slice and carried over by prefixes of one row a slice.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import calculus

#: Rows of a slice. A recording of 4 billion rows has as many slices, and a task sorts one of either.
SLICE_ROWS = 65_536


def met(rows: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with what ``found``, one row for each of their ``keys``, has beside them; NULL keys meet NULL keys."""
    on = reduce(lambda a, b: a & b, [F.col(f"x.`{k}`").eqNullSafe(F.col(f"y.`{k}`")) for k in keys])
    return rows.alias("x").join(found.alias("y"), on, "left").select("x.*", *[F.col(f"y.`{c}`") for c in found.columns if c not in keys])


def framed(df: DataFrame, recording: list[str], t: str, order: list[str], width: float) -> DataFrame:
    """``df`` with ``frame``, the place in the recording (from 0) by ``order``, which begins with ``t``, and ``frames``, their number.

    A task sorts the rows of one stretch of ``width`` of ``t``; the number of rows before it comes from the stretches'
    counts. Rows without a time come first. ``order`` must tell rows apart, or places would differ from one reading to the next.
    """
    own = df.withColumn("__cell", F.floor(F.col(t) / width))
    counts = own.groupBy(*recording, "__cell").agg(F.count("*").alias("__n"))
    whole = Window.partitionBy(*recording)  # a row a stretch
    before = counts.withColumns({"__before": F.sum("__n").over(whole.orderBy("__cell")) - F.col("__n"), "frames": F.sum("__n").over(whole)}).drop("__n")
    place = F.row_number().over(Window.partitionBy(*recording, "__cell").orderBy(*order))
    return met(own, before, [*recording, "__cell"]).withColumn("frame", F.col("__before") + place - 1).drop("__cell", "__before")


def slice_of(frame: Column | str, size: int) -> Column:
    return F.floor((F.col(frame) if isinstance(frame, str) else frame) / F.lit(size))


def over(df: DataFrame, recording: list[str], each: Callable[[DataFrame, list[str], list[str]], DataFrame], before: int = 0, after: int = 0, size: int = SLICE_ROWS) -> DataFrame:
    """What ``each`` (rows, keys, order) makes of slices of framed rows that know ``before`` rows back and ``after`` ahead.

    ``each`` may add columns by windows over keys and order, and keeps ``frame`` and the keys; of the neighbours' rows
    nothing is left. Results near the ends of a recording are as without slices, since there are no neighbours there.
    """
    first = F.greatest(F.lit(0), slice_of(F.col("frame") - after, size))
    last = F.least(slice_of(F.col("frame") + before, size), slice_of(F.col("frames") - 1, size))
    dealt = df.withColumn("__slice", F.explode(F.sequence(first, last)))
    return each(dealt, [*recording, "__slice"], ["frame"]).where(slice_of("frame", size) == F.col("__slice")).drop("__slice")


def running(df: DataFrame, recording: list[str], value: Column, name: str, size: int = SLICE_ROWS) -> DataFrame:
    """``df`` with the sum of ``value`` from the recording's first frame to this one."""
    own = df.withColumns({"__slice": slice_of("frame", size), "__value": value})
    totals = own.groupBy(*recording, "__slice").agg(F.sum("__value").alias("__total"))
    earlier = F.sum("__total").over(Window.partitionBy(*recording).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1))
    local = F.sum("__value").over(Window.partitionBy(*recording, "__slice").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0))
    found = met(own, totals.select(*recording, "__slice", F.coalesce(earlier, F.lit(0)).alias("__earlier")), [*recording, "__slice"])
    return found.withColumn(name, F.col("__earlier") + local).drop("__slice", "__value", "__earlier")


def nearest_known(df: DataFrame, recording: list[str], x: str, size: int = SLICE_ROWS) -> DataFrame:
    """``df`` with ``__last`` and ``__next``: frame and value (``f``, ``v``) of the last row up to this one, and of the first from it on, whose ``x`` isn't NULL."""
    own = df.withColumns({"__slice": slice_of("frame", size), "__known": F.when(F.col(x).isNotNull(), F.struct(F.col("frame").alias("f"), F.col(x).alias("v")))})
    ends = own.groupBy(*recording, "__slice").agg(F.min("__known").alias("__a"), F.max("__known").alias("__b"))
    by_slice = Window.partitionBy(*recording).orderBy("__slice")
    carried = ends.select(*recording, "__slice", F.max("__b").over(by_slice.rowsBetween(Window.unboundedPreceding, -1)).alias("__earlier"), F.min("__a").over(by_slice.rowsBetween(1, Window.unboundedFollowing)).alias("__later"))
    part = Window.partitionBy(*recording, "__slice").orderBy("frame")
    last = F.last("__known", ignorenulls=True).over(part.rowsBetween(Window.unboundedPreceding, 0))
    following = F.first("__known", ignorenulls=True).over(part.rowsBetween(0, Window.unboundedFollowing))
    found = met(own, carried, [*recording, "__slice"])
    return found.withColumns({"__last": F.coalesce(last, "__earlier"), "__next": F.coalesce(following, "__later")}).drop("__slice", "__known", "__earlier", "__later")


def derivatives(df: DataFrame, x: str, recording: list[str], rate: float = 1.0, size: int = SLICE_ROWS) -> DataFrame:
    """``calculus.derivatives`` of framed rows, by slices."""
    return over(df, recording, lambda d, keys, order: calculus.derivatives(d, x, keys, order, rate), 2, 2, size)


def finite_differences(df: DataFrame, x: str, t: str, recording: list[str], size: int = SLICE_ROWS) -> DataFrame:
    """``calculus.finite_differences`` of framed rows, by slices."""
    return over(df, recording, lambda d, keys, order: calculus.finite_differences(d, x, t, keys, order), before=2, size=size)


def rolling_median(df: DataFrame, x: str, name: str, recording: list[str], reach: int = 2, size: int = SLICE_ROWS) -> DataFrame:
    """``df`` with ``calculus.rolling_median`` as ``name``, by slices."""
    return over(df, recording, lambda d, keys, order: d.withColumn(name, calculus.rolling_median(x, keys, order, reach)), reach, reach, size)


def median_filter(df: DataFrame, x: str, name: str, recording: list[str], reach: int = 2, size: int = SLICE_ROWS) -> DataFrame:
    """``df`` with ``calculus.median_filter`` as ``name``, by slices."""
    return over(df, recording, lambda d, keys, order: d.withColumn(name, calculus.median_filter(x, keys, order, reach)), reach, reach, size)


def changed(df: DataFrame, value: str, recording: list[str], name: str, size: int = SLICE_ROWS) -> DataFrame:
    """``df`` with whether ``value``, a boolean without NULLs, differs from that of the frame before; so it does in the first frame."""
    new = lambda keys, order: F.col(value) != F.coalesce(F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)), ~F.col(value))
    return over(df, recording, lambda d, keys, order: d.withColumn(name, new(keys, order)), before=1, size=size)


def runs(df: DataFrame, flag: Column, recording: list[str], t: str, size: int = SLICE_ROWS) -> DataFrame:
    """``calculus.runs`` of framed rows: recording, run_id, start, end, n. A run may reach over any number of slices."""
    marked = changed(df.withColumn("__on", F.coalesce(flag, F.lit(False))), "__on", recording, "__new", size)
    numbered = running(marked, recording, F.col("__new").cast("long"), "run_id", size)
    return numbered.where("__on").groupBy(*recording, "run_id").agg(F.min(t).alias("start"), F.max(t).alias("end"), F.count("*").alias("n"))


def segments(df: DataFrame, ok: str, recording: list[str], size: int = SLICE_ROWS) -> DataFrame:
    """``df`` with ``__segment``, the number of the run of equal ``ok``, ``__at``, the row's place in it (from 0), and ``__of``, its number of rows."""
    numbered = running(changed(df, ok, recording, "__new", size), recording, F.col("__new").cast("long"), "__segment", size)
    spans = numbered.groupBy(*recording, "__segment").agg(F.min("frame").alias("__from"), F.count("*").alias("__of"))
    begun = nearest_known(numbered.withColumn("__begin", F.when(F.col("__new"), F.col("frame"))), recording, "__begin", size)
    return met(begun, spans.drop("__from"), [*recording, "__segment"]).withColumn("__at", F.col("frame") - F.col("__last.f")).drop("__new", "__begin", "__last", "__next")


def interpolated(df: DataFrame, x: str, recording: list[str], longest: int | None, size: int = SLICE_ROWS) -> DataFrame:
    """``calculus.interpolated`` of framed rows, by slices; gaps may reach over any number of them."""
    known = nearest_known(df, recording, x, size)
    gap = F.coalesce("__next.f", "frames") - F.coalesce("__last.f", F.lit(-1)) - 1
    inside = F.col("__last.v") + (F.col("__next.v") - F.col("__last.v")) * (F.col("frame") - F.col("__last.f")) / (F.col("__next.f") - F.col("__last.f"))
    value = F.coalesce(F.col(x), inside, F.col("__last.v"), F.col("__next.v"))
    filled = value if longest is None else F.when(F.col(x).isNotNull() | (gap <= longest), value)
    return known.withColumn(f"{x}_filled", filled).drop("__last", "__next")
