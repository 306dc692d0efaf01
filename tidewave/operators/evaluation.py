"""Evaluation of classifiers over seeds, held-out participants and train sizes.

``by_class_means`` is a model that aggregates alone can fit: all folds at once, with one row a fold and class. ``fitted``
runs any MLlib pipeline fold by fold; folds are few, since each is a model of its own.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def per_class(df: DataFrame, keys: list[str], truth: str, predicted: str) -> DataFrame:
    """keys, class, support, precision, recall, f1; a score without a denominator is 0."""
    cells = df.groupBy(*keys, F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(F.lit(0))
    sides = F.array(F.struct(F.col("t").alias("class"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("said"), hit.cast("long").alias("hit")), F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("said"), F.lit(0).cast("long").alias("hit")))
    classes = cells.select(*keys, F.inline(sides)).groupBy(*keys, "class").agg(*[F.sum(c).alias(c) for c in ("actual", "said", "hit")])
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return classes.select(*keys, "class", F.col("actual").alias("support"), share(F.col("hit"), F.col("said")).alias("precision"), share(F.col("hit"), F.col("actual")).alias("recall"), share(2 * F.col("hit"), F.col("actual") + F.col("said")).alias("f1"))


def fold_scores(df: DataFrame, keys: list[str], truth: str, predicted: str) -> DataFrame:
    """keys, n, accuracy, balanced_accuracy (mean recall of the classes that occur), weighted_f1, kappa."""
    classes = per_class(df, keys, truth, predicted)
    said = df.groupBy(*keys, F.col(predicted).alias("class")).agg(F.count("*").alias("said"))
    on = reduce(lambda a, b: a & b, [classes[k].eqNullSafe(said[k]) for k in keys] + [classes["class"].eqNullSafe(said["class"])])
    both = classes.join(said, on, "left").select(*[classes[c] for c in classes.columns], F.coalesce("said", F.lit(0)).alias("said"))
    n, seen = F.sum("support"), F.when(F.col("support") > 0, F.col("recall"))
    found = both.groupBy(*keys).agg(
        n.alias("n"), (F.sum(F.col("recall") * F.col("support")) / n).alias("accuracy"), F.avg(seen).alias("balanced_accuracy"),
        (F.sum(F.col("f1") * F.col("support")) / n).alias("weighted_f1"), (F.sum((F.col("support") * F.col("said")).cast("double")) / (n * n)).alias("__chance"),
    )
    return found.withColumn("kappa", F.try_divide(F.col("accuracy") - F.col("__chance"), 1 - F.col("__chance"))).drop("__chance")


def by_class_means(train: DataFrame, test: DataFrame, keys: list[str], label: str, features: list[str]) -> DataFrame:
    """``test`` with ``predicted``: the class whose mean over the fold's training rows is nearest, each feature in units of its spread there.

    ``keys`` name the fold in both tables. Training rows are summed to one row a fold and class, which go to the rows of
    their fold as one list. A fold without training rows predicts nothing (NULL). Ties go to the smaller class.
    """
    sums = train.dropna(subset=[label, *features]).groupBy(*keys, label).agg(*[e for f in features for e in (F.avg(f).alias(f"m_{f}"), F.sum(f).alias(f"s_{f}"), F.sum(F.col(f) * F.col(f)).alias(f"q_{f}"))], F.count("*").alias("n"))
    total = F.sum("n")
    spread = [F.sqrt(F.greatest(F.sum(f"q_{f}") / total - F.pow(F.sum(f"s_{f}") / total, 2), F.lit(0.0))).alias(f"sd_{f}") for f in features]
    model = sums.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(label).alias("class"), *[f"m_{f}" for f in features]))).alias("__classes"), *spread)

    def distance(c: Column) -> Column:
        parts = [F.pow(F.coalesce(F.try_divide(F.col(f) - c[f"m_{f}"], F.col(f"sd_{f}")), F.lit(0.0)), 2) for f in features]
        return F.struct(F.round(reduce(lambda a, b: a + b, parts), 9).alias("d"), c["class"].alias("class"))

    joined = test.join(model, keys, "left")
    return joined.withColumn("predicted", F.array_min(F.transform("__classes", distance))["class"]).drop("__classes", *[f"sd_{f}" for f in features])


def leave_one_out(df: DataFrame, group: str, label: str, features: list[str]) -> DataFrame:
    """``df`` with ``predicted`` by the class means of all other groups: every fold at once, from the sums of each group and class."""
    known = df.dropna(subset=[label, *features])
    values = [e for f in features for e in (F.sum(f).alias(f"s_{f}"), F.sum(F.col(f) * F.col(f)).alias(f"q_{f}"))]
    own = known.groupBy(group, label).agg(F.count("*").alias("n"), *values)
    names = ["n", *[f"{k}_{f}" for f in features for k in "sq"]]
    all_ = own.groupBy(label).agg(*[F.sum(c).alias(f"a_{c}") for c in names])
    pairs = own.select(group).distinct().join(F.broadcast(all_))  # a row a class
    left = pairs.join(own, [group, label], "left").select(group, label, *[(F.col(f"a_{c}") - F.coalesce(c, F.lit(0))).alias(c) for c in names]).where("n > 0")
    total = F.sum("n")
    spread = [F.sqrt(F.greatest(F.sum(f"q_{f}") / total - F.pow(F.sum(f"s_{f}") / total, 2), F.lit(0.0))).alias(f"sd_{f}") for f in features]
    classes = F.sort_array(F.collect_list(F.struct(F.col(label).alias("class"), *[(F.col(f"s_{f}") / F.col("n")).alias(f"m_{f}") for f in features])))
    model = left.groupBy(group).agg(classes.alias("__classes"), *spread)

    def distance(c: Column) -> Column:
        parts = [F.pow(F.coalesce(F.try_divide(F.col(f) - c[f"m_{f}"], F.col(f"sd_{f}")), F.lit(0.0)), 2) for f in features]
        return F.struct(F.round(reduce(lambda a, b: a + b, parts), 9).alias("d"), c["class"].alias("class"))

    return known.join(model, group).withColumn("predicted", F.array_min(F.transform("__classes", distance))["class"]).drop("__classes", *[f"sd_{f}" for f in features])


def fitted(df: DataFrame, fold: str, folds: list, make: Callable[[], Pipeline]) -> DataFrame:
    """The rows of each fold, predicted by the pipeline fitted on all others: the columns, and ``prediction``. Driver loop over the given folds, a model each."""
    parts = [make().fit(df.where(F.col(fold) != F.lit(f))).transform(df.where(F.col(fold) == F.lit(f))).select(*df.columns, "prediction") for f in folds]
    return reduce(DataFrame.unionByName, parts)


def temporal_sides(df: DataFrame, keys: list[str], order: list[str], sizes: list[int], buffer: int = 1) -> DataFrame:
    """Each row under each ``train_size``, with ``side``: of each key the first ``train_size`` rows in time are train, the next ``buffer`` neither, the rest test.

    A size counts for a key only if it leaves a test row.
    """
    part = Window.partitionBy(*keys)
    placed = df.withColumns({"__r": F.row_number().over(part.orderBy(*order)), "__n": F.count("*").over(part)})
    sized = placed.withColumn("train_size", F.explode(F.array(*[F.lit(s) for s in sizes])))
    side = F.when(F.col("__r") <= F.col("train_size"), "train").when(F.col("__r") > F.col("train_size") + buffer, "test")
    return sized.where(F.col("__n") >= F.col("train_size") + buffer + 1).withColumn("side", side).where("side is not null").drop("__r", "__n")
