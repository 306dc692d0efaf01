"""Column expressions that the operators share. NULL stands for missing; NaN and infinities become NULL at the edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """NULL in place of NaN and infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def clean_features(df: DataFrame, columns: list[str]) -> DataFrame:
    """The late fill of feature tables: NaN, infinities and NULL become 0. An explicit step, never implied."""
    return df.withColumns({c: F.coalesce(finite(F.col(c).cast("double")), F.lit(0.0)) for c in columns})


def row_mean(*columns: Column) -> Column:
    """Mean of the columns that aren't NULL; NULL if all are."""
    known = [F.when(c.isNotNull(), F.lit(1)).otherwise(F.lit(0)) for c in columns]
    total = reduce(lambda a, b: a + b, [F.coalesce(c.cast("double"), F.lit(0.0)) for c in columns])
    return F.try_divide(total, reduce(lambda a, b: a + b, known).cast("double"))


def clip(c: Column, low: Column, high: Column) -> Column:
    return F.greatest(F.least(c, high), low)


def autocorrelation(x: Column, previous: Column) -> Column:
    """Aggregate: correlation of a column with its predecessor. ``corr`` fails on constant segments under ANSI rules; this gives NULL."""
    both = F.when(previous.isNotNull(), x)
    return F.try_divide(F.covar_pop(both, previous), F.stddev_pop(both) * F.stddev_pop(previous))


def stars(p: Column) -> Column:
    """Significance marks at 0.05, 0.01 and 0.001."""
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def nullify_below(c: Column, confidence: Column, threshold: float) -> Column:
    """NULL where the confidence is below the threshold; an unknown confidence masks nothing."""
    return F.when(confidence.isNull() | (confidence >= threshold), c)


def binocular(left: Column, right: Column, left_pupil: Column, right_pupil: Column) -> Column:
    """The mean of both eyes, or the eye whose pupil was seen (isn't 0), else NULL."""
    l_ok, r_ok = F.coalesce(left_pupil != 0, F.lit(False)), F.coalesce(right_pupil != 0, F.lit(False))
    return F.when(l_ok & r_ok, (left + right) / 2).when(l_ok, left).when(r_ok, right)
