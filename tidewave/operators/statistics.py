"""Descriptive tables, mixed models by sufficient statistics, and evaluation of predictions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite


def by_group(df: DataFrame, group: list[str], x: str) -> DataFrame:
    """n, mean, sample sd and standard error of ``x``."""
    sd = F.stddev_samp(x)
    return df.groupBy(*group).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), sd.alias("sd"), F.try_divide(sd, F.sqrt(F.count(x).cast("double"))).alias("sem"))


def crosstab(df: DataFrame, rows: str, columns: str, values: list[str]) -> DataFrame:
    """Counts of each row value by column value, 0 where there are none."""
    return df.groupBy(rows).pivot(columns, values).count().fillna(0, values)


#: Bins that an interval of values is cut into, and values that are fetched to be ranked at the end.
BINS, FETCHED = 256, 100_000


def order_statistics(df: DataFrame, columns: list[str], spans: dict[str, tuple[float, float]], ranks: dict[str, list[int]]) -> dict[tuple[str, int], float]:
    """The values at ``ranks`` (from 0) of each column, whose known values lie in ``spans``; exact, without sorting.

    Values are counted in equal bins of the span, all columns in one job; of a rank's bin the smallest and largest value
    are its next span, until few values are left, which are ranked here. What moves is a row for each bin.
    """
    found: dict[tuple[str, int], float] = {}
    open_ = {(c, *spans[c], 0): list(ranks[c]) for c in columns if ranks[c]}  # (column, low, high, values below low): ranks
    while True:
        for key in [k for k in open_ if k[1] == k[2]]:
            found |= {(key[0], r): key[1] for r in open_.pop(key)}
        if not open_:
            return found
        cells = []
        for i, (c, low, high, _) in enumerate(open_):
            x, width = F.col(f"`{c}`").cast("double"), (high / BINS - low / BINS)
            cell = F.least(F.floor((x - F.lit(low)) / F.lit(width)), F.lit(BINS - 1)).cast("int") if width > 0 else F.when(x > low, 1).otherwise(0)
            cells.append(F.when(x.between(F.lit(low), F.lit(high)), F.struct(F.lit(i).alias("i"), cell.alias("cell"), x.alias("x"))))
        values = df.select(F.explode(F.array_compact(F.array(*cells))).alias("v")).select("v.*")
        counted = values.groupBy("i", "cell").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        bins: dict[int, list] = {}
        for r in sorted(counted.collect(), key=lambda r: (r["i"], r["cell"])):
            bins.setdefault(r["i"], []).append(r)
        narrower: dict[tuple, list[int]] = {}
        sizes = {}
        for i, ((c, _, _, below), own) in enumerate(open_.items()):
            for r in own:
                at = below
                for cell in bins[i]:
                    if r < at + cell["n"]:
                        narrower.setdefault((c, cell["low"], cell["high"], at), []).append(r)
                        sizes[c, cell["low"], cell["high"], at] = cell["n"]
                        break
                    at += cell["n"]
        open_ = narrower
        left = [k for k in open_ if k[1] < k[2]]
        if left and sum(sizes[k] for k in left) <= FETCHED:
            inside = [F.when(F.col(f"`{c}`").cast("double").between(F.lit(low), F.lit(high)), F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("double").alias("x"))) for i, (c, low, high, _) in enumerate(left)]
            held: dict[int, list[float]] = {}
            for r in df.select(F.explode(F.array_compact(F.array(*inside))).alias("v")).select("v.*").collect():
                held.setdefault(r["i"], []).append(r["x"])
            for i, key in enumerate(left):
                ordered = sorted(held[i])
                found |= {(key[0], r): ordered[r - key[3]] for r in open_.pop(key)}


def described(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row a column: n, mean, sd, min, quartiles (linear between values), max; exact, unlike ``summary``. NaN and infinities count as missing.

    No column is sorted or shuffled: one pass for the moments, then ``order_statistics``.
    """
    known = df.select(*[finite(F.col(f"`{c}`").cast("double")).alias(c) for c in columns])
    one = known.agg(*[e.alias(f"{k}_{i}") for i, c in enumerate(columns) for k, e in (("n", F.count(f"`{c}`")), ("mean", F.avg(f"`{c}`")), ("sd", F.stddev_samp(f"`{c}`")), ("min", F.min(f"`{c}`")), ("max", F.max(f"`{c}`")))]).first()
    n = {c: one[f"n_{i}"] for i, c in enumerate(columns)}
    places = {c: [(n[c] - 1) * q for q in (0.25, 0.5, 0.75)] if n[c] else [] for c in columns}
    ranks = {c: sorted({k for p in places[c] for k in (math.floor(p), math.ceil(p))}) for c in columns}
    at = order_statistics(known, columns, {c: (one[f"min_{i}"], one[f"max_{i}"]) for i, c in enumerate(columns)}, ranks)
    rows = []
    for i, c in enumerate(columns):
        between = [at[c, math.floor(p)] + (at[c, math.ceil(p)] - at[c, math.floor(p)]) * (p - math.floor(p)) for p in places[c]] or [None] * 3
        rows.append((c, n[c], one[f"mean_{i}"], one[f"sd_{i}"], one[f"min_{i}"], *between, one[f"max_{i}"]))
    return df.sparkSession.createDataFrame(rows, "column string, n long, mean double, sd double, min double, p25 double, p50 double, p75 double, max double")


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, nulls: one aggregate for all columns."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counted.select(F.expr(f"stack({len(columns)}, " + ", ".join(f"'{c}', `{c}`" for c in columns) + ") as (column, nulls)"))


def histogram(df: DataFrame, x: str, low: float, high: float, bins: int) -> DataFrame:
    """bin (1 to bins; values at ``high`` fall in the last), n."""
    cell = F.least(F.width_bucket(F.col(x), F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins)).cast("int")
    return df.where(F.col(x).between(low, high)).groupBy(cell.alias("bin")).agg(F.count("*").alias("n"))


def correlation_between(df: DataFrame, group: list[str], x: str, y: str, more_than: int) -> DataFrame:
    """n, r over rows where both are known; only groups with more than so many of them."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return both.groupBy(*group).agg(F.count("*").alias("n"), r.alias("r")).where(F.col("n") > more_than)


def sufficient(df: DataFrame, group: str, y: str, xs: list[str]) -> DataFrame:
    """n, sums and cross products of y and xs by group: all that a random-intercept model needs of the data."""
    names = [y, *xs]
    sums = [F.sum(c).alias(f"s_{c}") for c in names]
    products = [F.sum(F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for i, a in enumerate(names) for b in names[i:]]
    return df.dropna(subset=names).groupBy(group).agg(F.count("*").alias("n"), *sums, *products)


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """truth, predicted, n, row_share (%) for each pair of classes that occurs."""
    counts = df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    return counts.withColumn("row_share", F.col("n") * F.lit(100.0).cast("double") / F.sum("n").over(Window.partitionBy("truth")))


def scores(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: n, accuracy, balanced accuracy, weighted F1, Cohen's kappa. All from the confusion counts."""
    counts = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").cast("double").alias("n"))
    per = counts.select(F.explode(F.array(F.struct(F.col("t").alias("c"), F.col("n").alias("actual"), F.lit(0.0).alias("said"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(F.lit(0.0)).alias("hit")), F.struct(F.col("p").alias("c"), F.lit(0.0).alias("actual"), F.col("n").alias("said"), F.lit(0.0).alias("hit")))).alias("r")).select("r.*")
    classes = per.groupBy("c").agg(F.sum("actual").alias("actual"), F.sum("said").alias("said"), F.sum("hit").alias("hit"))
    f1 = F.coalesce(F.try_divide(2 * F.col("hit"), F.col("actual") + F.col("said")), F.lit(0.0))
    one = classes.agg(F.sum("actual").alias("n"), F.sum("hit").alias("hits"), F.avg(F.try_divide(F.col("hit"), F.col("actual"))).alias("balanced_accuracy"), F.sum(f1 * F.col("actual")).alias("f"), F.sum(F.col("actual") * F.col("said")).alias("chance"))
    accuracy, chance = F.try_divide(F.col("hits"), F.col("n")), F.try_divide(F.col("chance"), F.col("n") * F.col("n"))
    return one.select(F.col("n").cast("long").alias("n"), accuracy.alias("accuracy"), "balanced_accuracy", F.try_divide(F.col("f"), F.col("n")).alias("weighted_f1"), F.try_divide(accuracy - chance, 1 - chance).alias("kappa"))


def over_seeds(df: DataFrame, levels: list[list[str]], metric: str) -> DataFrame:
    """Means of means: ``metric`` is averaged over what each level of keys leaves out, and the last level also gets its sample sd."""
    for keys in levels[:-1]:
        df = df.groupBy(*keys).agg(F.avg(metric).alias(metric))
    last: list[Column] = [F.avg(metric).alias(f"{metric}_mean"), F.stddev_samp(metric).alias(f"{metric}_std"), F.count("*").alias("n")]
    return df.groupBy(*levels[-1]).agg(*last)


def mean_confusion(df: DataFrame, run: str, truth: str, predicted: str) -> DataFrame:
    """truth, predicted, mean: the counts of each cell averaged over the runs; a cell that a run lacks counts as 0 there."""
    cells = df.groupBy(run, truth, predicted).agg(F.count("*").alias("n"))
    runs = cells.select(run).distinct().agg(F.count("*").alias("r")).first()["r"]  # one number
    return cells.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg((F.sum("n") / F.lit(float(runs or 1))).alias("mean"))


def sem_from_interval(low: Column, high: Column) -> Column:
    """Standard error from the ends of a 95 % interval."""
    return (high - low) / (2 * 1.96)


def eliminated(df: DataFrame, feature: str, importance: str, share: float, least: int) -> DataFrame:
    """feature, importance (mean over folds), rank, dropped: the max(1, floor(share n)) least important go, while ``least`` stay.

    The ranking is over one row a feature.
    """
    means = df.groupBy(feature).agg(F.avg(importance).alias("importance"))
    n = F.count("*").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy("importance", feature))
    gone = F.least(F.greatest(F.lit(1), F.floor(n * F.lit(share))), F.greatest(F.lit(0), n - least))
    return means.withColumns({"rank": rank, "dropped": rank <= gone})
