"""From a heart signal to its rate: cleaning, classes of beats and their repair, the averaged beat, a monotone rate and its spectrum."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import slices, windows
from .signal import low_pass

CLASSES = ("normal", "ectopic", "missed", "extra", "long", "short")


def cleaned(df: DataFrame, key: str, order: list[str], x: str, rate: float, drift: float = 0.5, mains: float = 50.0, width: float | None = None) -> DataFrame:
    """key, order, x and ``<x>_clean``: without what is slower than ``drift`` (a zero-phase filter), averaged over a turn of the ``mains``.

    With ``width`` a recording is cut into slices, see ``slices``.
    """
    low = low_pass(df, key, order, x, drift, rate, order=5, width=width).withColumn("__x", F.col(x) - F.col(f"{x}_smooth")).drop(f"{x}_smooth")
    turn = max(1, round(rate / mains))
    before, after = turn // 2, turn - turn // 2 - 1
    mean = lambda keys, by: F.when(F.col("__x").isNotNull(), F.avg("__x").over(Window.partitionBy(*keys).orderBy(*by).rowsBetween(-before, after)))
    if width is None:
        return low.withColumn(f"{x}_clean", mean([key], order)).drop("__x")
    framed = slices.framed(low, [key], order[0], order, width)
    return slices.over(framed, [key], lambda d, k, o: d.withColumn(f"{x}_clean", mean(k, o)), before, after).drop("__x", "frame", "frames")


def classified(peaks: DataFrame, keys: list[str], t: str, reach: int = 45, near: int = 5, factor: float = 5.2, least: float = 50.0) -> DataFrame:
    """``peaks`` with ``rr`` (ms since the peak before) and ``class``, one of ``CLASSES``.

    Changes of rr, and its distance from the median of the 2 near + 1 around, are measured in units of ``factor`` times
    half the range of quartiles of their sizes among the 2 reach + 1 around, at least ``least`` ms (Lipponen and
    Tarvainen, 2019). A peak between a short and a long interval, or the reverse, is ectopic; one that cuts a usual
    interval in two is extra; half of an interval being usual, a peak before it was missed; else it is long or short.
    """
    part = Window.partitionBy(*keys).orderBy(t)
    wide, close = part.rowsBetween(-reach, reach), part.rowsBetween(-near, near)

    def limit(c: str) -> Column:
        size = F.abs(c)
        return F.greatest((F.percentile(size, F.lit(0.75)).over(wide) - F.percentile(size, F.lit(0.25)).over(wide)) / 2 * factor, F.lit(least))

    timed = peaks.withColumn("rr", (F.col(t) - F.lag(t).over(part)) * 1000).withColumn("__drr", F.col("rr") - F.lag("rr").over(part))
    off = timed.withColumn("__median", F.percentile("rr", F.lit(0.5)).over(close)).withColumn("__off", F.col("rr") - F.col("__median"))
    off = off.withColumn("__off", F.when(F.col("__off") < 0, 2 * F.col("__off")).otherwise(F.col("__off")))
    scaled = off.withColumns({"__d": F.col("__drr") / limit("__drr"), "__limit": limit("__off")})
    known = scaled.withColumns({"__d1": F.lead("__d", 1).over(part), "__d2": F.lead("__d", 2).over(part), "__rr1": F.lead("rr").over(part)})
    d, d1, d2 = F.col("__d"), F.col("__d1"), F.col("__d2")
    ectopic = ((d1 > 1) & (F.greatest(d, d2) < -0.13 * d1 - 0.17)) | ((d1 < -1) & (F.least(d, d2) > -0.13 * d1 + 0.17))
    turned = ((d > 1) & (F.least(d1, d2) < -1)) | ((d < -1) & (F.greatest(d1, d2) > 1))
    odd = turned | (F.abs("__off") > 3 * F.col("__limit"))
    kind = (
        F.when(ectopic, "ectopic").when(odd & (F.abs(F.col("rr") / 2 - F.col("__median")) < F.col("__limit")), "missed")
        .when(odd & (F.abs(F.col("rr") + F.col("__rr1") - F.col("__median")) < F.col("__limit")), "extra")
        .when(odd & (F.col("__off") > 0), "long").when(odd, "short").otherwise("normal")
    )
    return known.withColumn("class", kind).drop("__drr", "__median", "__off", "__d", "__limit", "__d1", "__d2", "__rr1")


def repaired(peaks: DataFrame, keys: list[str], t: str, rounds: int = 3) -> DataFrame:
    """keys, t, ``status`` (kept, moved, inserted): a missed peak is put in the middle, an extra one goes, others of a class move between their neighbours.

    Of neighbours with a class the first is mended in a round, so that what it did to the others' intervals is gone in
    the next. All rounds keep the partitioning by key.
    """
    part = Window.partitionBy(*keys).orderBy(t)
    out = peaks.select(*keys, t).withColumn("status", F.lit("kept"))
    for _ in range(rounds):
        told = classified(out, keys, t)
        placed = told.withColumns({"__before": F.lag(t).over(part), "__after": F.lead(t).over(part), "__due": F.coalesce(F.lag("class").over(part) == "normal", F.lit(True))})
        own = lambda at, status: F.struct(at.alias("t"), status.alias("status"))
        here, middle = F.col(t), (F.col("__before") + F.col("__after")) / 2
        mended = (
            F.when((F.col("class") == "normal") | ~F.col("__due"), F.array(own(here, F.col("status"))))
            .when(F.col("class") == "missed", F.array(own((F.col("__before") + here) / 2, F.lit("inserted")), own(here, F.col("status"))))
            .when(F.col("class") == "extra", F.array().cast("array<struct<t:double,status:string>>"))
            .otherwise(F.array(own(F.coalesce(middle, here), F.when(middle.isNull(), F.col("status")).otherwise("moved"))))
        )
        out = placed.select(*keys, F.explode(mended).alias("m")).select(*keys, F.col("m.t").alias(t), F.col("m.status").alias("status"))
    return out


def averaged_beat(samples: DataFrame, beats: DataFrame, keys: list[str], x: str, before: int, after: int) -> DataFrame:
    """keys, frame (of the beat), distance, quality: how far the samples around a beat lie from the recording's mean beat, and 1 less that by the largest.

    ``samples`` have ``frame``; a beat's samples are found by their frames, and the mean beat has one row for each of
    ``before`` + ``after`` + 1 places.
    """
    around = beats.select(*keys, F.col("frame").alias("beat"), F.explode(F.sequence(F.col("frame") - before, F.col("frame") + after)).alias("frame"))
    epochs = around.join(samples.select(*keys, "frame", F.col(x).alias("__x")), [*keys, "frame"]).withColumn("__place", F.col("frame") - F.col("beat"))
    mean = epochs.groupBy(*keys, "__place").agg(F.avg("__x").alias("__mean"))
    found = epochs.join(mean, [*keys, "__place"]).groupBy(*keys, F.col("beat").alias("frame")).agg(F.sqrt(F.sum(F.pow(F.col("__x") - F.col("__mean"), 2))).alias("distance"))
    largest = found.groupBy(*keys).agg(F.max("distance").alias("__most"))
    return found.join(largest, keys).withColumn("quality", 1 - F.coalesce(F.try_divide("distance", "__most"), F.lit(0.0))).drop("__most")


def monotone_cubic(points: DataFrame, keys: list[str], t: str, y: str, step: float) -> DataFrame:
    """keys, ``n``, ``t``, ``y``: a cubic through the points that rises and falls with them alone, at all multiples n of ``step`` from the first to the last.

    Slopes are weighted harmonic means of the secants on both sides, zero where these differ in sign, and at the ends
    three-point ones within bounds (Fritsch and Butland, 1984). Each interval makes its own samples. Points must differ
    in t; two are joined by a line, one gives no samples.
    """
    part = Window.partitionBy(*keys).orderBy("__t")
    own = points.where(F.col(t).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(t).alias("__t"), F.col(y).cast("double").alias("__y"))
    own = own.withColumns({"__h": F.lead("__t").over(part) - F.col("__t"), "__dy": F.lead("__y").over(part) - F.col("__y")}).withColumn("__s", F.col("__dy") / F.col("__h"))
    own = own.withColumns({f"__{c}{k}": (F.lag if k == "p" else F.lead)(f"__{c}", n).over(part) for c in "hs" for k, n in (("p", 1), ("n", 1))} | {f"__{c}pp": F.lag(f"__{c}", 2).over(part) for c in "hs"})
    h, s, hp, sp = (F.col(f"__{c}") for c in ("h", "s", "hp", "sp"))
    a, b = 2 * h + hp, h + 2 * hp
    inner = F.when(sp * s <= 0, F.lit(0.0)).otherwise((a + b) / (a / sp + b / s))

    def end(h0: Column, h1: Column, s0: Column, s1: Column) -> Column:
        slope = ((2 * h0 + h1) * s0 - h0 * s1) / (h0 + h1)
        return F.when(s1.isNull(), s0).when(slope * s0 <= 0, F.lit(0.0)).when((s0 * s1 <= 0) & (F.abs(slope) > 3 * F.abs(s0)), 3 * s0).otherwise(slope)

    slope = F.when(sp.isNull(), end(h, F.col("__hn"), s, F.col("__sn"))).when(s.isNull(), end(hp, F.col("__hpp"), sp, F.col("__spp"))).otherwise(inner)
    bent = own.withColumn("__m", slope).withColumns({"__m1": F.lead("__m").over(part), "__y1": F.lead("__y").over(part), "__t1": F.lead("__t").over(part), "__last": F.lead("__t", 2).over(part).isNull()}).where("__t1 is not null")
    first = F.ceil(F.col("__t") / step)
    last = F.when(F.col("__last"), F.floor(F.col("__t1") / step)).otherwise(F.ceil(F.col("__t1") / step) - 1)
    at = bent.where(first <= last).withColumn("n", F.explode(F.sequence(first, last))).withColumn("__u", (F.col("n") * step - F.col("__t")) / F.col("__h"))
    u = F.col("__u")
    value = (2 * u * u * u - 3 * u * u + 1) * F.col("__y") + (u * u * u - 2 * u * u + u) * h * F.col("__m") + (3 * u * u - 2 * u * u * u) * F.col("__y1") + (u * u * u - u * u) * h * F.col("__m1")
    return at.select(*keys, "n", (F.col("n") * F.lit(float(step))).alias("t"), value.alias("y"))


def periodogram(x: np.ndarray, rate: float) -> np.ndarray:
    """One-sided density of a segment less its mean, under a Hann window."""
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(len(x)) / len(x))
    power = np.abs(np.fft.rfft((x - x.mean()) * taper)) ** 2 / (rate * (taper**2).sum())
    power[1 : (len(x) + 1) // 2] *= 2
    return power


def welch(samples: DataFrame, keys: list[str], order: list[str], x: str, rate: float, size: int) -> DataFrame:
    """keys, segments, f, density: periodograms of segments of ``size`` samples, half overlapping, averaged. Recordings shorter than a segment have none.

    A task transforms one segment at a time, as a row.
    """

    @F.pandas_udf("array<double>")
    def density(series: pd.Series) -> pd.Series:
        return pd.Series([periodogram(np.asarray(v, float), rate) for v in series])

    dealt = windows.by_count(samples.where(F.col(x).isNotNull()), keys, order, size, size // 2)
    lists = dealt.groupBy(*keys, "window_index").agg(F.sort_array(F.collect_list(F.struct("frame", F.col(x).alias("v")))).alias("__s"))
    spectra = lists.select(*keys, density(F.transform("__s", lambda r: r["v"])).alias("__p"))
    lines = spectra.select(*keys, F.posexplode("__p").alias("__i", "__d"))
    return lines.groupBy(*keys, "__i").agg(F.count("*").alias("segments"), F.avg("__d").alias("density")).select(*keys, "segments", (F.col("__i") * F.lit(rate / size)).alias("f"), "density")


#: Bands in Hz, half open.
BANDS = {"ulf": (0.0, 0.0033), "vlf": (0.0033, 0.04), "lf": (0.04, 0.15), "hf": (0.15, 0.4), "vhf": (0.4, 0.5)}


def band_powers(spectrum: DataFrame, keys: list[str], width: float, bands: dict[str, tuple[float, float]] = BANDS) -> DataFrame:
    """keys, hrv_<band> for each band, hrv_tp (their sum), hrv_lfn, hrv_hfn (shares of the total), hrv_lfhf, hrv_lnhf, from lines of ``width``."""
    power = [(F.coalesce(F.sum(F.when((F.col("f") >= lo) & (F.col("f") < hi), F.col("density"))), F.lit(0.0)) * width).alias(f"hrv_{b}") for b, (lo, hi) in bands.items()]
    found = spectrum.groupBy(*keys).agg(*power)
    total = sum((F.col(f"hrv_{b}") for b in bands), F.lit(0.0))
    shares = {"hrv_tp": total, "hrv_lfn": F.try_divide(F.col("hrv_lf"), total), "hrv_hfn": F.try_divide(F.col("hrv_hf"), total), "hrv_lfhf": F.try_divide("hrv_lf", "hrv_hf"), "hrv_lnhf": F.when(F.col("hrv_hf") > 0, F.log("hrv_hf"))}
    return found.withColumns(shares)


def hrv_more(rr: DataFrame, keys: list[str], bin_ms: float = 7.8125) -> DataFrame:
    """keys and columns from moments and quantiles of the intervals ``rr`` and their changes ``drr``: variation, percentiles, the triangular index and Poincare forms."""
    known = rr.where(F.col("rr").isNotNull())
    middle = known.groupBy(*keys).agg(F.percentile("rr", F.lit(0.5)).alias("__median"), F.avg("rr").alias("__mean"), F.stddev_samp("rr").alias("__sdnn"), F.sqrt(F.avg(F.col("drr") * F.col("drr"))).alias("__rmssd"), F.stddev_samp("drr").alias("__sdsd"), F.count("*").alias("n_rr"), F.percentile("rr", F.lit(0.2)).alias("hrv_prc20nn"), F.percentile("rr", F.lit(0.8)).alias("hrv_prc80nn"))
    off = known.join(middle.select(*keys, "__median"), keys).groupBy(*keys).agg((F.percentile(F.abs(F.col("rr") - F.col("__median")), F.lit(0.5)) * 1.4826).alias("hrv_madnn"))
    bins = known.groupBy(*keys, F.floor(F.col("rr") / bin_ms).alias("__bin")).agg(F.count("*").alias("__n")).groupBy(*keys).agg(F.max("__n").alias("__top"))
    sd1, sd2 = F.col("__sdsd") / F.sqrt(F.lit(2.0)), F.sqrt(F.greatest(2 * F.col("__sdnn") * F.col("__sdnn") - F.col("__sdsd") * F.col("__sdsd") / 2, F.lit(0.0)))
    return middle.join(off, keys).join(bins, keys).select(
        *keys, "n_rr", F.try_divide("__rmssd", "__mean").alias("hrv_cvsd"), F.try_divide("__sdnn", "__rmssd").alias("hrv_sdrmssd"), "hrv_madnn", F.try_divide("hrv_madnn", "__median").alias("hrv_mcvnn"), "hrv_prc20nn", "hrv_prc80nn",
        (F.col("n_rr") / F.col("__top")).alias("hrv_hti"), (sd1 * sd2 * np.pi).alias("hrv_s"), F.try_divide(sd2, sd1).alias("hrv_csi"), F.when((sd1 > 0) & (sd2 > 0), F.log10(16 * sd1 * sd2)).alias("hrv_cvi"), F.try_divide(4 * sd2 * sd2, sd1).alias("hrv_csi_modified"),
    )


def hrv_fragments(rr: DataFrame, keys: list[str], t: str) -> DataFrame:
    """keys and shares of the asymmetry of successive intervals (rr, drr by t), and of runs of rising, falling and alternating ones.

    Of points (interval before, interval): hrv_si and hrv_ai by angle to and area from the diagonal, hrv_c1d, hrv_cd and
    hrv_ca by variance. hrv_ials is segments of equal sign by their intervals, hrv_pss the share of intervals outside of
    such segments of three or more, hrv_pas that in alternating ones of four or more (Costa, Davis and Goldberger, 2017).
    """
    known = rr.where(F.col("drr").isNotNull()).select(*keys, F.col(t).alias("__t"), "rr", "drr")
    part = Window.partitionBy(*keys).orderBy("__t")
    x, y = F.col("rr") - F.col("drr"), F.col("rr")
    angle, sign = F.abs(F.atan2(y, x) - np.pi / 4), F.signum("drr")
    signed = known.withColumns({"__angle": angle, "__area": angle * (x * x + y * y) / 2, "__sign": sign, "__before": F.lag(sign).over(part)})
    marked = signed.withColumns({"__new": F.coalesce((F.col("__sign") != F.col("__before")).cast("int"), F.lit(1)), "__turned": F.coalesce(F.col("__sign") * F.col("__before") < 0, F.lit(False))})
    counted = marked.withColumns({"__run": F.sum("__new").over(part), "__alternating": F.sum((~F.col("__turned")).cast("int")).over(part)})
    runs = counted.where("__sign <> 0").groupBy(*keys, "__run").agg(F.count("*").alias("__n")).groupBy(*keys).agg(F.count("*").alias("__runs"), F.sum("__n").alias("__in_runs"), F.sum(F.when(F.col("__n") >= 3, F.col("__n")).otherwise(0)).alias("__in_long"))
    # an alternating run holds the interval that its first turn follows
    turns = counted.groupBy(*keys, "__alternating").agg(F.count("*").alias("__n")).groupBy(*keys).agg(F.sum(F.when(F.col("__n") >= 4, F.col("__n")).otherwise(0)).alias("__in_turns"))
    above = lambda c, s: F.sum(F.when(F.col("__sign") == s, c).otherwise(F.lit(0.0)))
    d2 = F.col("drr") * F.col("drr")
    along = F.pow(F.col("rr") * 2 - F.col("drr") - 2 * F.col("__mean"), 2)
    half = lambda s: F.sum(F.when(F.col("__sign") == s, d2 + along).when(F.col("__sign") == 0, along / 2).otherwise(F.lit(0.0)))
    means = rr.where(F.col("rr").isNotNull()).groupBy(*keys).agg(F.avg("rr").alias("__mean"))
    share = lambda a, b: F.try_divide(a * 100, a + b)
    sums = counted.join(means, keys).groupBy(*keys).agg(
        F.count("*").alias("n"), share(above(F.col("__angle"), 1), above(F.col("__angle"), -1)).alias("hrv_si"), share(above(F.col("__area"), 1), above(F.col("__area"), -1)).alias("hrv_ai"),
        share(above(d2, 1), above(d2, -1)).alias("hrv_c1d"), share(half(1), half(-1)).alias("hrv_cd"), share(half(-1), half(1)).alias("hrv_ca"),
    )
    joined = sums.join(runs, keys, "left").join(turns, keys, "left")
    percent = lambda c: F.coalesce(F.col(c), F.lit(0)) * F.lit(100.0).cast("double") / F.col("n")
    return joined.select(*sums.columns, F.try_divide(F.col("__runs").cast("double"), F.col("__in_runs").cast("double")).alias("hrv_ials"), (100 - percent("__in_long")).alias("hrv_pss"), percent("__in_turns").alias("hrv_pas"))
