"""Ordered functions over a recording: derivatives, medians, runs, interpolation, adjustment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clip


def gradient(x: str, part: Window, rate: float = 1.0) -> Column:
    """Central differences inside, one-sided ones at the ends, times ``rate``; NULL for a single row."""
    before, after = F.lag(x).over(part), F.lead(x).over(part)
    first, last = F.row_number().over(part) == 1, F.lead(F.lit(1)).over(part).isNull()
    return F.when(first, after - F.col(x)).when(last, F.col(x) - before).otherwise((after - before) / 2) * F.lit(rate)


def derivatives(df: DataFrame, x: str, recording: list[str], order: list[str], rate: float = 1.0) -> DataFrame:
    """``<x>_vel`` and ``<x>_acc``; both use the partitioning and order of one shuffle."""
    part = Window.partitionBy(*recording).orderBy(*order)
    return df.withColumn(f"{x}_vel", gradient(x, part, rate)).withColumn(f"{x}_acc", gradient(f"{x}_vel", part, rate))


def finite_differences(df: DataFrame, x: str, t: str, recording: list[str], order: list[str]) -> DataFrame:
    """``<x>_vel`` by the real time step, and ``<x>_acc`` from it; NULL where there is no earlier row or time stands still."""
    part = Window.partitionBy(*recording).orderBy(*order)
    step = F.col(t) - F.lag(t).over(part)
    df = df.withColumn("__dt", step).withColumn(f"{x}_vel", F.try_divide(F.col(x) - F.lag(x).over(part), F.col("__dt")))
    return df.withColumn(f"{x}_acc", F.try_divide(F.col(f"{x}_vel") - F.lag(f"{x}_vel").over(part), F.col("__dt"))).drop("__dt")


def around(x: str, recording: list[str], order: list[str], reach: int) -> Column:
    """Sorted values of the rows up to ``reach`` before and after."""
    return F.sort_array(F.collect_list(x).over(Window.partitionBy(*recording).orderBy(*order).rowsBetween(-reach, reach)))


def rolling_median(x: str, recording: list[str], order: list[str], reach: int = 2) -> Column:
    """Centred median of the rows there are; the mean of the middle two if their number is even."""
    a = around(x, recording, order, reach)
    n = F.size(a)
    return (F.get(a, F.floor((n - 1) / 2).cast("int")) + F.get(a, F.floor(n / 2).cast("int"))) / 2


def median_filter(x: str, recording: list[str], order: list[str], reach: int = 2) -> Column:
    """Median of 2 reach + 1 values, with zeros beyond the ends."""
    a = around(x, recording, order, reach)
    full = F.sort_array(F.concat(a, F.array_repeat(F.lit(0.0), F.lit(2 * reach + 1) - F.size(a))))
    return F.get(full, F.lit(reach))


def clipped_median(df: DataFrame, x: str, recording: list[str], order: list[str], deviations: float = 5.0) -> DataFrame:
    """``<x>_clipped``: the median-filtered signal, held within its mean and so many population deviations."""
    whole = Window.partitionBy(*recording)
    df = df.withColumn("__m", median_filter(x, recording, order))
    mean, sd = F.avg("__m").over(whole), F.stddev_pop("__m").over(whole)
    return df.withColumn(f"{x}_clipped", clip(F.col("__m"), mean - deviations * sd, mean + deviations * sd)).drop("__m")


def runs(df: DataFrame, flag: Column, recording: list[str], order: list[str], t: str) -> DataFrame:
    """Runs of rows whose flag is true: run_id, start, end, n. Gaps and islands by a running count of changes."""
    part = Window.partitionBy(*recording).orderBy(*order)
    marked = df.withColumn("__on", F.coalesce(flag, F.lit(False)))
    change = (F.col("__on") != F.coalesce(F.lag("__on").over(part), ~F.col("__on"))).cast("int")
    numbered = marked.withColumn("__change", change).withColumn("run_id", F.sum("__change").over(part.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.where("__on").groupBy(*recording, "run_id").agg(F.min(t).alias("start"), F.max(t).alias("end"), F.count("*").alias("n"))


def interpolated(df: DataFrame, x: str, frame: str, recording: list[str], longest: int | None) -> DataFrame:
    """``<x>_filled``: linear over gaps of at most ``longest`` rows; short gaps at the ends take the nearest value, longer ones stay NULL."""
    part = Window.partitionBy(*recording).orderBy(frame)
    back, ahead = part.rowsBetween(Window.unboundedPreceding, 0), part.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(x).isNotNull(), F.col(frame))
    df = df.withColumns({
        "__v0": F.last(x, ignorenulls=True).over(back), "__f0": F.last(known, ignorenulls=True).over(back),
        "__v1": F.first(x, ignorenulls=True).over(ahead), "__f1": F.first(known, ignorenulls=True).over(ahead),
        "__lo": F.min(frame).over(Window.partitionBy(*recording)), "__hi": F.max(frame).over(Window.partitionBy(*recording)),
    })
    gap = F.coalesce("__f1", F.col("__hi") + 1) - F.coalesce("__f0", F.col("__lo") - 1) - 1
    inside = F.col("__v0") + (F.col("__v1") - F.col("__v0")) * (F.col(frame) - F.col("__f0")) / (F.col("__f1") - F.col("__f0"))
    value = F.coalesce(F.col(x), inside, F.col("__v0"), F.col("__v1"))
    filled = value if longest is None else F.when(F.col(x).isNotNull() | (gap <= longest), value)
    return df.withColumn(f"{x}_filled", filled).drop("__v0", "__f0", "__v1", "__f1", "__lo", "__hi")


def outliers_to_zero(df: DataFrame, x: str, recording: list[str], deviations: float = 3.0) -> DataFrame:
    """Values further than so many sample deviations from the recording's mean become 0, the mark of a lost signal."""
    whole = Window.partitionBy(*recording)
    far = F.abs(F.col(x) - F.avg(x).over(whole)) > deviations * F.stddev_samp(x).over(whole)
    return df.withColumn(f"{x}_masked", F.when(far, F.lit(0.0)).otherwise(F.col(x)))


def holm(df: DataFrame, p: str, family: list[str], tie: list[str]) -> DataFrame:
    """``p_holm``: min(1, p (m - i + 1)) by ascending p within a family, without a running maximum."""
    part = Window.partitionBy(*family)
    rank = F.row_number().over(part.orderBy(p, *tie))
    return df.withColumn("p_holm", F.least(F.lit(1.0), F.col(p) * (F.count(p).over(part) - rank + 1)))
