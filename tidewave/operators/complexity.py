"""Entropies, fractal dimensions and scaling of the intervals between beats, window by window.

What has a relational form is one: ordinal patterns, value frequencies, Higuchi's curve lengths, Katz's dimension. The
rest compares stretches of a window with each other: ``close_pairs`` sorts them by their first value, so that each is
held against those alone whose first value is near. A window must hold a bounded number of intervals; more are an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Intervals of a window: more than a day's beats have no place in one row.
MOST_INTERVALS = 200_000

#: Scales of coarse-graining, radii of the correlation sum, and moments of the fluctuations.
SCALES, RADII, MOMENTS = range(1, 6), 8, np.array([-5, -4, -3, -2, -1, 0, 1, 2, 3, 4, 5], float)

#: Box sizes of the short- and the long-term exponents, as usual for heart rates.
SHORT, LONG = tuple(range(4, 17)), tuple(range(16, 65, 4))


def close_pairs(at: np.ndarray, within: float) -> Iterator[np.ndarray]:
    """For each row of ``at``, in the order of first values, its distances (largest difference) to the rows after it whose first value is at most ``within`` away."""
    at = at[np.argsort(at[:, 0], kind="stable")]
    ends = np.searchsorted(at[:, 0], at[:, 0] + within, side="right")
    for i in range(len(at) - 1):
        yield np.abs(at[i + 1 : ends[i]] - at[i]).max(axis=1, initial=0)


def stretches(x: np.ndarray, m: int, n: int | None = None) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(x, m)[:n]


def matches(x: np.ndarray, m: int, within: float, n: int) -> int:
    """Pairs among the first ``n`` stretches of ``m`` values that differ by at most ``within`` everywhere."""
    return sum(int((d <= within).sum()) for d in close_pairs(stretches(x, m, n), within)) if n > 1 else 0


def sample_counts(x: np.ndarray, m: int, within: float) -> tuple[int, int]:
    """Matching pairs of stretches of m and of m + 1 values, as many of either."""
    n = len(x) - m
    return (matches(x, m, within, n), matches(x, m + 1, within, n)) if n > 1 else (0, 0)


def log_ratio(short: float, long: float) -> float | None:
    return float(np.log(short / long)) if short and long else None


def approximate_entropy(x: np.ndarray, m: int = 2, share: float = 0.2) -> float | None:
    """How much less often stretches of m + 1 values recur than those of m, each of them counted as its own match."""
    if len(x) < m + 2 or not x.std():
        return None
    within = share * x.std(ddof=1)

    def phi(k: int) -> float:
        at = stretches(x, k)
        order = np.argsort(at[:, 0], kind="stable")
        found = np.ones(len(at))
        sorted_at = at[order]
        ends = np.searchsorted(sorted_at[:, 0], sorted_at[:, 0] + within, side="right")
        for i in range(len(at) - 1):
            hit = i + 1 + np.flatnonzero(np.abs(sorted_at[i + 1 : ends[i]] - sorted_at[i]).max(axis=1, initial=0) <= within)
            found[i] += len(hit)
            found[hit] += 1
        return float(np.log(found / len(at)).mean())

    return phi(m) - phi(m + 1)


def fuzzy_entropy(x: np.ndarray, m: int = 2, share: float = 0.2) -> float | None:
    """As sample entropy, with a likeness exp(-(d / r)^2) of stretches less their means in place of matches. Likenesses under 1e-12 count as none."""
    if len(x) < m + 2 or not x.std():
        return None
    within, n = share * x.std(ddof=1), len(x) - m

    def likeness(k: int) -> float:
        at = stretches(x, k, n)
        far = within * np.sqrt(-np.log(1e-12))
        return sum(float(np.exp(-((d / within) ** 2)).sum()) for d in close_pairs(at - at.mean(axis=1, keepdims=True), far))

    return log_ratio(likeness(m), likeness(m + 1))


def coarse(x: np.ndarray, scale: int, offset: int = 0) -> np.ndarray:
    """Means of successive stretches of ``scale`` values."""
    x = x[offset : offset + (len(x) - offset) // scale * scale]
    return x.reshape(-1, scale).mean(axis=1)


def multiscale(x: np.ndarray, m: int = 2, share: float = 0.2) -> tuple[float | None, float | None, float | None]:
    """Sample entropy averaged over scales: of one coarse-graining, of the mean over all offsets, and with the offsets' matches added up first."""
    if len(x) < 2 * (m + 2) or not x.std():
        return None, None, None
    within, means = share * x.std(ddof=1), ([], [], [])
    for scale in SCALES:
        counts = [sample_counts(coarse(x, scale, k), m, within) for k in range(scale)]
        each = [e for c in counts if (e := log_ratio(*c)) is not None]
        found = log_ratio(*counts[0]), float(np.mean(each)) if len(each) == len(counts) else None, log_ratio(*np.sum(counts, axis=0))
        for kept, e in zip(means, found, strict=True):
            if e is not None:
                kept.append(e)
    return tuple(float(np.mean(e)) if e else None for e in means)


def parsed_phrases(bits: np.ndarray) -> int:
    """How many phrases the sequence falls into, each the shortest that hasn't been seen before it (Lempel and Ziv, 1976)."""
    text, at, n = "".join("01"[int(b)] for b in bits), 0, 0
    while at < len(text):
        length = 1
        while at + length <= len(text) and text.find(text[at : at + length], 0, at + length - 1) >= 0:
            length += 1
        at, n = at + length, n + 1
    return n


def lempel_ziv(x: np.ndarray) -> float | None:
    """Phrases of the sequence of values above the mean, by what a random one of its length has."""
    return float(parsed_phrases(x > x.mean()) * np.log2(len(x)) / len(x)) if len(x) > 1 else None


def correlation_dimension(x: np.ndarray, m: int = 2) -> float | None:
    """Slope of the logarithm of how many pairs of stretches lie within a radius, over radii from a tenth of to one standard deviation."""
    if len(x) < m + 2 or not x.std():
        return None
    radii = x.std() * np.geomspace(0.1, 1.0, RADII)
    sums = np.zeros(RADII)
    for d in close_pairs(stretches(x, m), radii[-1]):
        sums += np.searchsorted(np.sort(d), radii, side="right")
    return float(np.polyfit(np.log(radii[sums > 0]), np.log(sums[sums > 0]), 1)[0]) if (sums > 0).sum() > 1 else None


def fluctuations(x: np.ndarray, size: int) -> np.ndarray:
    """Mean square of what a line leaves in each box of the cumulative sum."""
    walk = np.cumsum(x - x.mean())
    boxes = walk[: len(walk) // size * size].reshape(-1, size).T
    line = np.column_stack([np.arange(size), np.ones(size)])
    return ((boxes - line @ np.linalg.lstsq(line, boxes, rcond=None)[0]) ** 2).mean(axis=0)


def scaling(x: np.ndarray, sizes: tuple[int, ...]) -> np.ndarray | None:
    """The exponents h(q) of the fluctuations for all ``MOMENTS``; None for fewer values than two boxes of the largest size, or boxes that don't fluctuate."""
    if len(x) < 2 * sizes[-1] or not x.std():
        return None
    logs = np.empty((len(sizes), len(MOMENTS)))
    for i, size in enumerate(sizes):
        f = fluctuations(x, size)
        if f.min() <= 1e-12 * x.var():
            return None
        logs[i] = [np.log(f).mean() / 2 if q == 0 else np.log((f ** (q / 2)).mean()) / q for q in MOMENTS]
    return np.polyfit(np.log(sizes), logs, 1)[0]


SPECTRUM = ("Width", "Peak", "Mean", "Max", "Delta", "Asymmetry", "Fluctuation", "Increment")


def spectrum(h: np.ndarray | None) -> list[float | None]:
    """Of the singularity spectrum of exponents h(q): width, place of its peak, mean place, height, difference of its ends' heights and asymmetry; and mean squares of the second and first differences of h."""
    if h is None:
        return [None] * len(SPECTRUM)
    tau = MOMENTS * h - 1
    alpha = np.gradient(tau, MOMENTS)
    height = MOMENTS * alpha - tau
    width, peak = np.ptp(alpha), alpha[height.argmax()]
    skew = (peak - alpha.min()) / width - 0.5 if width > 0 else 0.0
    return [float(v) for v in (width, peak, alpha.mean(), height.max(), height[alpha.argmax()] - height[alpha.argmin()], skew, (np.diff(h, 2) ** 2).mean(), (np.diff(h) ** 2).mean())]


def triangle_base(x: np.ndarray, bin_ms: float = 7.8125) -> float | None:
    """Width of the base of the triangle that fits the histogram best, its top at the highest bin."""
    if len(x) < 2:
        return None
    cells = np.floor(x / bin_ms).astype(np.int64)
    counts = np.bincount(cells - cells.min() + 1, minlength=1)
    counts = np.append(counts, 0).astype(float)
    top, at = int(counts.argmax()), np.arange(len(counts))
    rises = [np.where(at <= top, np.clip((at - a) / (top - a), 0, None), 0) * counts[top] for a in range(top)]
    falls = [np.where(at > top, np.clip((b - at) / (b - top), 0, None), 0) * counts[top] for b in range(top + 1, len(counts))]
    left = min(range(top), key=lambda a: float(((counts - rises[a])[: top + 1] ** 2).sum()))
    right = min(range(top + 1, len(counts)), key=lambda b: float(((counts - falls[b - top - 1])[top + 1 :] ** 2).sum()))
    return float((right - left) * bin_ms)


def measured(x: np.ndarray) -> dict[str, float | None]:
    """All columns of ``hrv_complexity`` of one window's intervals."""
    plain, composite, refined = multiscale(x)
    short, long = scaling(x, SHORT), scaling(x, LONG)
    two = int(np.flatnonzero(MOMENTS == 2)[0])
    out = {
        "hrv_apen": approximate_entropy(x), "hrv_fuzzyen": fuzzy_entropy(x), "hrv_msen": plain, "hrv_cmsen": composite, "hrv_rcmsen": refined,
        "hrv_lzc": lempel_ziv(x), "hrv_cd": correlation_dimension(x), "hrv_tinn": triangle_base(x),
        "hrv_dfa_alpha2": None if long is None else float(long[two]),
    }
    for name, h in (("alpha1", short), ("alpha2", long)):
        out |= {f"hrv_mfdfa_{name}_{k.lower()}": v for k, v in zip(SPECTRUM, spectrum(h), strict=True)}
    return out


COLUMNS = tuple(measured(np.arange(4.0)))


def lists_of(rr: DataFrame, keys: list[str], t: str, least: int) -> DataFrame:
    """keys, n_rr and ``__rr``, the intervals of each window in order, at least ``least`` of them. More than ``MOST_INTERVALS`` are an error."""
    ordered = F.sort_array(F.collect_list(F.when(F.col("rr").isNotNull(), F.struct(F.col(t).alias("t"), "rr"))))
    known = rr.withColumn("__n", F.count("rr").over(Window.partitionBy(*keys)))
    refused = F.raise_error(F.concat(F.lit(f"a window has more than {MOST_INTERVALS} intervals: "), F.col("__n").cast("string"))).cast("double")
    bounded = known.withColumn("rr", F.when(F.col("__n") > MOST_INTERVALS, refused).otherwise(F.col("rr")))
    lists = bounded.groupBy(*keys).agg(F.transform(ordered, lambda r: r["rr"]).alias("__rr"))
    return lists.where(F.size("__rr") >= least).select(*keys, F.size("__rr").alias("n_rr"), "__rr")


def hrv_complexity(rr: DataFrame, keys: list[str], t: str, least: int = 5, of: Callable[[np.ndarray], dict] = measured) -> DataFrame:
    """keys, n_rr and ``COLUMNS`` of each window; a column that too few intervals, or ones without change, can't tell is NULL."""

    @F.pandas_udf(", ".join(f"{c} double" for c in COLUMNS))
    def columns(series: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([of(np.asarray(x, float)) for x in series], columns=list(COLUMNS), dtype=float)

    found = lists_of(rr, keys, t, least).select(*keys, "n_rr", columns("__rr").alias("m")).select(*keys, "n_rr", "m.*")
    return found.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in COLUMNS})


def entropy_of(counts: Column) -> Column:
    """Aggregate over a row for each kind: Shannon entropy of the kinds' counts in bits."""
    n = F.sum(counts)
    return F.log2(n.cast("double")) - F.sum(counts * F.log2(counts.cast("double"))) / n


def hrv_symbols(rr: DataFrame, keys: list[str], t: str, step_ms: float = 1.0) -> DataFrame:
    """keys, hrv_shanen, hrv_permen: Shannon entropy of the intervals in steps of ``step_ms``, and of the orders of three successive ones, by log2(6). NULL without such."""
    known = rr.where(F.col("rr").isNotNull())
    values = known.groupBy(*keys, F.round(F.col("rr") / step_ms).alias("__v")).agg(F.count("*").alias("__n"))
    shannon = values.groupBy(*keys).agg(entropy_of(F.col("__n")).alias("hrv_shanen"))
    part = Window.partitionBy(*keys).orderBy(t)
    one, two = F.lead("rr", 1).over(part), F.lead("rr", 2).over(part)
    kind = F.concat_ws("", *[(a <= b).cast("int") for a, b in ((F.col("rr"), F.col("__1")), (F.col("__1"), F.col("__2")), (F.col("rr"), F.col("__2")))])
    patterns = known.withColumns({"__1": one, "__2": two}).where("__2 is not null").groupBy(*keys, kind.alias("__kind")).agg(F.count("*").alias("__n"))
    permuted = patterns.groupBy(*keys).agg((entropy_of(F.col("__n")) / F.log2(F.lit(6.0))).alias("hrv_permen"))
    return shannon.join(permuted, keys, "left")


def hrv_curves(rr: DataFrame, keys: list[str], t: str, longest: int = 8) -> DataFrame:
    """keys, n_rr, hrv_hfd, hrv_kfd: Higuchi's dimension from curve lengths at steps of 1 to ``longest`` intervals, and Katz's.

    Higuchi's needs twice as many intervals as the longest step, both some change. Steps are rows, so one ordering for each step and phase gives all lengths.
    """
    part = Window.partitionBy(*keys)
    known = rr.where(F.col("rr").isNotNull()).select(*keys, F.col(t).alias("__t"), F.col("rr").alias("__x"))
    placed = known.withColumns({"__i": F.row_number().over(part.orderBy("__t")) - 1, "__n": F.count("*").over(part), "__first": F.first("__x").over(part.orderBy("__t").rowsBetween(Window.unboundedPreceding, 0)), "__before": F.lag("__x").over(part.orderBy("__t"))})
    path = F.sum(F.abs(F.col("__x") - F.col("__before")))
    farthest = F.max(F.abs(F.col("__x") - F.col("__first")))
    steps = F.log((F.count("*") - 1).cast("double"))
    katz = placed.groupBy(*keys).agg(F.count("*").alias("n_rr"), F.when((F.count("*") > 2) & (farthest > 0), steps / (steps + F.log(F.try_divide(farthest, path)))).alias("hrv_kfd"))
    spread = placed.where(F.col("__n") >= 2 * longest).withColumn("__k", F.explode(F.sequence(F.lit(1), F.lit(longest)))).withColumn("__m", F.col("__i") % F.col("__k"))
    back = F.lag("__x").over(Window.partitionBy(*keys, "__k", "__m").orderBy("__i"))
    lengths = spread.withColumn("__d", F.abs(F.col("__x") - back)).groupBy(*keys, "__k", "__m").agg(F.sum("__d").alias("__d"), F.count("__d").alias("__c"), F.first("__n").alias("__n"))
    curve = F.avg(F.col("__d") * (F.col("__n") - 1) / F.col("__c") / F.col("__k") / F.col("__k"))
    by_step = lengths.groupBy(*keys, "__k").agg(curve.alias("__l")).where("__l > 0")
    higuchi = by_step.groupBy(*keys).agg(F.when(F.count("*") == longest, F.regr_slope(F.log("__l"), -F.log(F.col("__k").cast("double")))).alias("hrv_hfd"))
    return katz.join(higuchi, keys, "left").select(*keys, "n_rr", "hrv_hfd", "hrv_kfd")
