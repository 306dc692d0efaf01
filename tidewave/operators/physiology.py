"""Heart-rate variability and skin-conductance features of windows."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import autocorrelation
from . import slices
from .signal import low_pass


def rr_intervals(peaks: DataFrame, keys: list[str], t: str) -> DataFrame:
    """``rr`` in ms between successive peaks, and its change ``drr``."""
    part = Window.partitionBy(*keys).orderBy(t)
    return peaks.withColumn("rr", (F.col(t) - F.lag(t).over(part)) * 1000).withColumn("drr", F.col("rr") - F.lag("rr").over(part))


def corrected(rr: DataFrame, keys: list[str], t: str, share: float = 0.2, reach: int = 5) -> DataFrame:
    """``rr`` with ``artefact``, ``rr_clean`` and ``rate``: intervals that differ from the median of those around them by more than ``share`` of it give way to it.

    ``rate`` is in beats a minute, from the clean interval. An interval without neighbours is its own median.
    """
    around = Window.partitionBy(*keys).orderBy(t).rowsBetween(-reach, reach)
    median = F.percentile("rr", F.lit(0.5)).over(around)
    marked = rr.withColumn("__m", median).withColumn("artefact", F.coalesce(F.abs(F.col("rr") - F.col("__m")) > share * F.col("__m"), F.lit(False)))
    clean = F.when(F.col("artefact"), F.col("__m")).otherwise(F.col("rr"))
    return marked.withColumn("rr_clean", clean).withColumn("rate", F.try_divide(F.lit(60000.0).cast("double"), F.col("rr_clean"))).drop("__m")


def signal_quality(rr: DataFrame, keys: list[str]) -> DataFrame:
    """n, quality (share of intervals that are no artefacts) and mean rate for each key, from ``corrected``."""
    return rr.where("rr is not null").groupBy(*keys).agg(F.count("*").alias("n"), F.avg((~F.col("artefact")).cast("double")).alias("quality"), F.avg("rate").alias("rate_mean"))


def hrv_time(rr: DataFrame, keys: list[str], least_peaks: int = 5) -> DataFrame:
    """Time-domain and Poincare features of windows with at least so many peaks."""
    sd_change = F.stddev_samp("drr")
    sdnn = F.stddev_samp("rr")
    median = F.percentile("rr", F.lit(0.5))
    sd1 = sd_change / F.sqrt(F.lit(2.0))
    sd2 = F.sqrt(F.greatest(2 * sdnn * sdnn - sd_change * sd_change / 2, F.lit(0.0)))
    return rr.groupBy(*keys).agg(
        F.count("*").alias("n_peaks"), F.try_divide(F.lit(60000.0).cast("double"), F.avg("rr")).alias("heart_rate_mean"),
        F.avg("rr").alias("hrv_mean_nn"), sdnn.alias("hrv_sdnn"), F.sqrt(F.avg(F.col("drr") * F.col("drr"))).alias("hrv_rmssd"), sd_change.alias("hrv_sdsd"),
        F.try_divide(sdnn, F.avg("rr")).alias("hrv_cvnn"), median.alias("hrv_median_nn"),
        (F.percentile("rr", F.lit(0.75)) - F.percentile("rr", F.lit(0.25))).alias("hrv_iqr_nn"),
        F.try_divide(F.count_if(F.abs("drr") > 50) * F.lit(100.0).cast("double"), F.count("rr").cast("double")).alias("hrv_pnn50"),
        F.try_divide(F.count_if(F.abs("drr") > 20) * F.lit(100.0).cast("double"), F.count("rr").cast("double")).alias("hrv_pnn20"),
        F.min("rr").alias("hrv_min_nn"), F.max("rr").alias("hrv_max_nn"), sd1.alias("hrv_sd1"), sd2.alias("hrv_sd2"), F.try_divide(sd1, sd2).alias("hrv_sd1sd2"),
    ).where(F.col("n_peaks") >= least_peaks)


def eda(df: DataFrame, keys: list[str], order: list[str], is_peak: str, amplitude: str, tonic: str, signal: str, size: int | None = None, share: float = 0.9) -> DataFrame:
    """SCR peaks, their mean amplitude, sd of the tonic level and lag-1 autocorrelation; windows with a NULL in the signal or tonic level go, and with ``size``, the rows of a full window, those of less than ``share`` of it."""
    lagged = df.withColumn("__prev", F.lag(signal).over(Window.partitionBy(*keys).orderBy(*order)))
    peak = F.col(is_peak)
    found = lagged.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count(F.col(signal) + F.col(tonic)).alias("__known"), F.count_if(peak).alias("scr_peaks_n"),
        F.avg(F.when(peak, F.col(amplitude))).alias("scr_peaks_amplitude_mean"), F.stddev_samp(tonic).alias("eda_tonic_sd"),
        autocorrelation(F.col(signal), F.col("__prev")).alias("eda_autocorrelation"),
    )
    full = F.lit(True) if size is None else F.col("n") >= size * share
    return found.where((F.col("__known") == F.col("n")) & full).drop("__known")


def _beats(timed: DataFrame, part: Window, x: str, near: int, apart: int, far: int, factor: float) -> DataFrame:
    """The rows of ``timed`` (with ``frame``) at which the energy of the slope tells a beat, with ``__peak``, the highest sample around."""
    slope = F.col(x) - F.lag(x).over(part)
    energy = timed.withColumn("__slope", slope * slope).withColumn("__energy", F.avg("__slope").over(part.rowsBetween(-near, near)))
    top = energy.withColumns({
        "__level": F.avg("__energy").over(part.rowsBetween(-far, far)),
        "__before": F.coalesce(F.max("__energy").over(part.rowsBetween(-apart, -1)), F.lit(-1.0)),
        "__after": F.coalesce(F.max("__energy").over(part.rowsBetween(1, apart)), F.lit(-1.0)),
        "__peak": F.max(F.when(F.col(x).isNotNull(), F.struct(F.col(x).alias("height"), (-F.col("frame")).alias("back")))).over(part.rowsBetween(-near, near)),
    })
    return top.where((F.col("__energy") > F.col("__level") * factor) & (F.col("__energy") > F.col("__before")) & (F.col("__energy") >= F.col("__after")) & F.col("__peak").isNotNull())


def r_peaks(df: DataFrame, keys: list[str], order: list[str], x: str, rate: float, factor: float = 1.5, half: float = 0.06, refractory: float = 0.3, around: float = 2.0, width: float | None = None, slice_rows: int = slices.SLICE_ROWS) -> DataFrame:
    """Beats of a sampled signal: the keys, ``frame`` (from 0) and ``height`` of each R peak.

    The energy of the slope, averaged over ``half`` seconds on both sides, must be the highest within the refractory
    time and exceed ``factor`` times its mean ``around`` the beat; the peak is the highest sample within ``half`` of it
    (the first of equal ones). All frames are over one ordering, so a recording is shuffled and sorted once; with
    ``width``, a stretch of the first column of ``order``, it is cut into slices instead, and no task holds a recording.
    NULLs have no slope and are no peak. Equivalent to the usual slope detectors, not equal to any of them bit by bit.
    """
    near, apart, far = (max(1, round(s * rate)) for s in (half, refractory, around))
    if width is None:
        part = Window.partitionBy(*keys).orderBy(*order)
        beats = _beats(df.withColumn("frame", F.row_number().over(part) - 1), part, x, near, apart, far, factor)
    else:
        reach = near + max(apart, far) + 1
        beats = slices.over(slices.framed(df, keys, order[0], order, width), keys, lambda d, k, o: _beats(d, Window.partitionBy(*k).orderBy(*o), x, near, apart, far, factor), reach, reach, slice_rows)
    return beats.select(*keys, (-F.col("__peak.back")).cast("int").alias("frame"), F.col("__peak.height").alias("height")).distinct()


#: Very low, low and high frequencies in Hz.
BANDS = {"vlf": (0.0033, 0.04), "lf": (0.04, 0.15), "hf": (0.15, 0.4)}


def hrv_frequency(rr: DataFrame, keys: list[str], t: str, bands: dict[str, tuple[float, float]] = BANDS, steps: int = 8, least: int = 5) -> DataFrame:
    """Power of the intervals in each band (ms squared), its share of lf + hf, and lf / hf, without resampling.

    The periodogram of the unevenly spaced intervals is taken at ``steps`` frequencies in the middle of equal parts of a
    band; a band's power is their mean density times its width. All frequencies are sums over one row an interval, so a
    task remembers one row a key; means and sums keep the partitioning by key, so nothing is shuffled twice.
    """
    grid = [(b, lo + (hi - lo) * (i + 0.5) / steps) for b, (lo, hi) in bands.items() for i in range(steps)]
    whole = Window.partitionBy(*keys)
    known = rr.where(F.col("rr").isNotNull()).select(*keys, F.col(t).alias("__t"), "rr")
    centred = known.withColumns({"__x": F.col("rr") - F.avg("rr").over(whole), "__at": F.col("__t") - F.min("__t").over(whole)})
    turns = [F.lit(f) * F.col("__at") * 6.283185307179586 for _, f in grid]
    sums = [F.sum(F.col("__x") * of(turn)).alias(f"__{k}{i}") for i, turn in enumerate(turns) for k, of in (("c", F.cos), ("s", F.sin))]
    lines = centred.groupBy(*keys).agg(F.count("*").alias("n_rr"), (F.sum("rr") / 1000).alias("__span"), *sums).where(F.col("n_rr") >= least)
    density = [2 * (F.col(f"__c{i}") * F.col(f"__c{i}") + F.col(f"__s{i}") * F.col(f"__s{i}")) * F.col("__span") / (F.col("n_rr") * F.col("n_rr")) for i in range(len(grid))]
    power = {b: reduce(lambda x, y: x + y, [d * F.lit(hi - lo) / steps for d, (own, _) in zip(density, grid, strict=True) if own == b]) for b, (lo, hi) in bands.items()}
    found = lines.select(*keys, "n_rr", *[p.alias(f"hrv_{b}") for b, p in power.items()])
    both = F.col("hrv_lf") + F.col("hrv_hf")
    return found.withColumns({"hrv_lfn": F.try_divide("hrv_lf", both), "hrv_hfn": F.try_divide("hrv_hf", both), "hrv_lfhf": F.try_divide("hrv_lf", "hrv_hf")})


def matching_templates(x: np.ndarray, m: int, within: float, n: int) -> int:
    """Pairs among the first ``n`` stretches of ``m`` values that differ by at most ``within`` everywhere; one row at a time, in memory of n values."""
    at = np.lib.stride_tricks.sliding_window_view(x, m)[:n]
    return sum(int((np.abs(at[i + 1 :] - at[i]).max(axis=1, initial=0) <= within).sum()) for i in range(len(at) - 1))


def sample_entropy(x: np.ndarray, m: int = 2, share: float = 0.2) -> float | None:
    """-ln of the chance that stretches of ``m`` values which match, within ``share`` of the sd, also match in the next value; None without matches."""
    if len(x) < m + 2:
        return None
    within, n = share * x.std(ddof=1), len(x) - m
    short, long = matching_templates(x, m, within, n), matching_templates(x, m + 1, within, n)
    return float(-np.log(long / short)) if long and short else None


def scaling_exponent(x: np.ndarray, sizes: tuple[int, ...] = tuple(range(4, 17))) -> float | None:
    """Short-term exponent of detrended fluctuations; None for fewer values than two boxes of the largest size, or without change."""
    if len(x) < 2 * sizes[-1] or not x.std():
        return None
    walk, out = np.cumsum(x - x.mean()), []
    for s in sizes:
        boxes = walk[: len(walk) // s * s].reshape(-1, s).T
        line = np.column_stack([np.arange(s), np.ones(s)])
        left = boxes - line @ np.linalg.lstsq(line, boxes, rcond=None)[0]
        out.append(np.sqrt((left * left).mean()))
    return float(np.polyfit(np.log(sizes), np.log(out), 1)[0]) if min(out) > 0 else None


def hrv_nonlinear(rr: DataFrame, keys: list[str], t: str, least: int = 5) -> DataFrame:
    """n_rr, sample entropy and short-term scaling exponent of each window. A window of seconds holds a bounded number of beats, so its intervals fit one row."""

    @F.pandas_udf("hrv_sampen double, hrv_dfa_alpha1 double")
    def of(series: pd.Series) -> pd.DataFrame:
        arrays = [np.asarray(x, float) for x in series]
        return pd.DataFrame({"hrv_sampen": pd.Series([sample_entropy(x) for x in arrays], dtype=float), "hrv_dfa_alpha1": pd.Series([scaling_exponent(x) for x in arrays], dtype=float)})

    ordered = F.sort_array(F.collect_list(F.when(F.col("rr").isNotNull(), F.struct(F.col(t).alias("t"), "rr"))))
    lists = rr.groupBy(*keys).agg(F.transform(ordered, lambda r: r["rr"]).alias("__rr")).where(F.size("__rr") >= least)
    measured = lists.select(*keys, F.size("__rr").alias("n_rr"), of("__rr").alias("m")).select(*keys, "n_rr", "m.*")
    return measured.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("hrv_sampen", "hrv_dfa_alpha1")})


def eda_split(df: DataFrame, key: str, order: list[str], x: str, rate: float, cutoff: float = 0.05) -> DataFrame:
    """``tonic``, what a zero-phase low-pass leaves of the signal, and ``phasic``, the rest."""
    low = low_pass(df, key, order, x, cutoff, rate, order=2)
    return low.withColumnRenamed(f"{x}_smooth", "tonic").withColumn("phasic", F.col(x) - F.col("tonic"))


def eda_cleaned(df: DataFrame, key: str, order: list[str], x: str, rate: float, cutoff: float = 3.0, width: float | None = None) -> DataFrame:
    """key, order, x and ``<x>_clean``: a zero-phase low-pass of order 4, where the rate can hold the cutoff; recordings in slices with ``width``."""
    if cutoff >= rate / 2:
        return df.select(key, *order, x).withColumn(f"{x}_clean", F.col(x).cast("double"))
    return low_pass(df, key, order, x, cutoff, rate, order=4, width=width).withColumnRenamed(f"{x}_smooth", f"{x}_clean")


def eda_high_pass(df: DataFrame, key: str, order: list[str], x: str, rate: float, cutoff: float = 0.05, width: float | None = None) -> DataFrame:
    """key, order, x, ``phasic``, a zero-phase high-pass of order 2 of the signal, and ``tonic``, a low-pass of it at the same cutoff."""
    low = low_pass(df, key, order, x, cutoff, rate, order=2, width=width)
    high = low_pass(df.select(key, *order, x), key, order, x, cutoff, rate, order=2, width=width, high=True).select(*[F.col(c).alias(f"__{c}") for c in (key, *order)], F.col(f"{x}_smooth").alias("phasic"))
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (key, *order)]
    return low.withColumnRenamed(f"{x}_smooth", "tonic").join(high, on).select(key, *order, x, "tonic", "phasic")


def scr_peaks(df: DataFrame, keys: list[str], order: list[str], phasic: str, least: float = 0.1) -> DataFrame:
    """Adds ``scr_amplitude``, the rise of a local maximum above the trough before it, and ``scr_peak``: whether that is at least ``least`` of the recording's largest.

    Other rows have a NULL amplitude. A maximum with no trough before it is no response. All over one ordering of a recording.
    """
    part = Window.partitionBy(*keys).orderBy(*order)
    x, before, after = F.col(phasic), F.lag(phasic).over(part), F.lead(phasic).over(part)
    marked = df.withColumns({"__top": (x > before) & (x >= after), "__low": F.when((x < before) & (x <= after), x)})
    onset = F.last("__low", ignorenulls=True).over(part.rowsBetween(Window.unboundedPreceding, -1))
    risen = marked.withColumn("scr_amplitude", F.when(F.col("__top"), x - onset))
    largest = F.max("scr_amplitude").over(Window.partitionBy(*keys))
    return risen.withColumn("scr_peak", F.coalesce(F.col("scr_amplitude") >= largest * least, F.lit(False))).drop("__top", "__low")
