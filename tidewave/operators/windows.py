"""Assignment of samples to overlapping windows, and statistics within them.

A window's samples are found by arithmetic, so each sample is copied to at most ceil(size / hop) windows and nothing is
joined. All steps keep the partitioning by recording: one shuffle serves assignment, ordering and aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import autocorrelation

STATISTICS = ("n", "min", "max", "rms", "mean", "std", "median", "p25", "p75", "autocorr1")


def by_time(df: DataFrame, recording: list[str], t: str, size: float, hop: float, tail: float = 1.0) -> DataFrame:
    """Half-open windows [k hop, k hop + size) from time 0; the last one starts before the last sample less ``size`` plus ``tail``.

    Windows without samples give no rows but keep their index. Adds ``window_index`` and ``t_start``.
    """
    last = F.max(t).over(Window.partitionBy(*recording))
    k = F.explode(F.sequence(F.greatest(F.lit(0), (F.floor((F.col(t) - size) / hop) + 1).cast("int")), F.floor(F.col(t) / hop).cast("int")))
    dealt = df.where(F.col(t) >= 0).withColumn("__last", last).withColumn("window_index", k)
    start = F.col("window_index") * F.lit(float(hop))
    return dealt.withColumn("t_start", start).where(start < F.col("__last") - size + tail).drop("__last")


def by_count(df: DataFrame, recording: list[str], order: list[str], size: int, hop: int) -> DataFrame:
    """Windows of ``size`` rows every ``hop`` rows (one at least), complete ones only. Adds ``frame`` (from 0) and ``window_index``."""
    part = Window.partitionBy(*recording)
    framed = df.withColumns({"frame": F.row_number().over(part.orderBy(*order)) - 1, "frames": F.count("*").over(part)})
    return by_frame(framed, size, hop).drop("frames")


def by_frame(framed: DataFrame, size: int, hop: int) -> DataFrame:
    """The same for rows that have ``frame`` and ``frames``, the number of rows of their recording: arithmetic alone."""
    hop = max(1, hop)
    first = F.greatest(F.lit(0), F.ceil((F.col("frame") - size + 1) / F.lit(float(hop))).cast("int"))
    dealt = framed.withColumn("window_index", F.explode(F.sequence(first, F.floor(F.col("frame") / F.lit(float(hop))).cast("int"))))
    return dealt.where(F.col("window_index") * hop + size <= F.col("frames"))


def spine(recordings: DataFrame, total: float, size: float, step: float) -> DataFrame:
    """max(1, int((total - size) / step) + 1) windows with both ends closed for each recording, also where no sample falls."""
    n = max(1, int((total - size) / step) + 1)
    k = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    return recordings.distinct().withColumn("window_index", k).withColumns({"t_start": F.col("window_index") * float(step), "t_end": F.col("window_index") * float(step) + float(size)})


def in_closed_windows(df: DataFrame, t: str, total: float, size: float, step: float) -> DataFrame:
    """Each row under each closed window that holds it: a row on a boundary lies in one window more."""
    n = max(1, int((total - size) / step) + 1)
    first = F.greatest(F.lit(0), F.ceil((F.col(t) - size) / step).cast("int"))
    last = F.least(F.lit(n - 1), F.floor(F.col(t) / step).cast("int"))
    return df.where((F.col(t) >= 0) & (first <= last)).withColumn("window_index", F.explode(F.sequence(first, last)))


def statistics(df: DataFrame, keys: list[str], x: str, order: list[str], minimum: int | None = None) -> DataFrame:
    """The ten statistics of ``x`` for each key. With ``minimum``, windows with fewer values have NULLs (but their row)."""
    lagged = df.withColumn("__prev", F.lag(x).over(Window.partitionBy(*keys).orderBy(*order)))
    v = F.col(x)
    found: dict[str, Column] = {
        "min": F.min(v), "max": F.max(v), "rms": F.sqrt(F.avg(v * v)), "mean": F.avg(v), "std": F.stddev_pop(v),
        "median": F.percentile(v, F.lit(0.5)), "p25": F.percentile(v, F.lit(0.25)), "p75": F.percentile(v, F.lit(0.75)),
        "autocorr1": autocorrelation(v, F.col("__prev")),
    }
    valid = F.count(v) >= minimum if minimum else None
    return lagged.groupBy(*keys).agg(F.count(v).alias("n"), *[(F.when(valid, e) if minimum else e).alias(k) for k, e in found.items()])


def every_nth(df: DataFrame, n: int, index: str = "window_index") -> DataFrame:
    """Each n-th window, so that half-overlapping ones share no samples."""
    return df.where(F.col(index) % n == 0)


def judged(df: DataFrame, keys: list[str], x: str, most_missing: float, least_rows: int) -> DataFrame:
    """One row a window: n, missing (share), status (ok or skipped), reason. Windows that are dropped later keep their index."""
    found = df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.col(x).isNull().cast("double")).alias("missing"))
    reason = F.when(F.col("n") < least_rows, "too short").when(F.col("missing") > most_missing, "too much missing")
    return found.withColumns({"status": F.when(reason.isNull(), "ok").otherwise("skipped"), "reason": reason})
