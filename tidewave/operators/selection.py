"""Feature selection and tuning around an MLlib model. The driver holds names and scores; rows stay in Spark."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import PCA, Imputer, StandardScaler, VectorAssembler, VectorSlicer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import splits, statistics

#: Rows that change places with each other when a column is permuted; a task sorts about so many.
PERMUTED_TOGETHER = 100_000


def partnered(df: DataFrame, key: str, columns: list[str], seed: Column | int = 0, groups: Column | int = 1, keys: list[str] | None = None) -> DataFrame:
    """``df`` with ``__other``, a struct of the ``columns`` of another row with equal ``keys``, drawn at random. ``key`` is a whole number, different in each row.

    Rows are dealt to groups by a hash and change values inside their group, by two rankings, so no task sorts the
    whole table. ``seed`` and ``groups`` may depend on the ``keys``.
    """
    own = [*(keys or []), "__group"]
    group = (splits.spread(F.col(key), seed) % groups).alias("__group")
    place = lambda s: F.row_number().over(Window.partitionBy(*own).orderBy(splits.spread(F.col(key), s) % 1000003, key)).alias("__place")
    left = df.select("*", group).select("*", place(seed + 1))
    right = df.select("*", group).select(*own, F.struct(*columns).alias("__other"), place(seed + 2))
    return left.join(right, [*own, "__place"]).select(*df.columns, "__other")


def permuted(df: DataFrame, key: str, column: str, seed: int = 0, groups: int | None = None) -> DataFrame:
    """``df`` with the values of one column dealt anew at random, as ``partnered`` does. The number of groups follows the number of rows unless it is given."""
    n = groups or max(1, df.count() // PERMUTED_TOGETHER)
    return partnered(df, key, [column], seed, n).withColumn(column, F.col("__other")[column]).select(*df.columns)


def forest(features: list[str], trees: int = 500, depth: int = 30, seed: int = 1) -> Pipeline:
    """Medians for missing values, standard scores, a random forest on ``label`` with ``weight``. MLlib has no least size of a node to split."""
    return Pipeline(stages=[
        Imputer(inputCols=features, outputCols=[f"{c}__filled" for c in features], strategy="median"),
        VectorAssembler(inputCols=[f"{c}__filled" for c in features], outputCol="__raw"),
        StandardScaler(inputCol="__raw", outputCol="features", withMean=True),
        RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=2, featureSubsetStrategy="log2", weightCol="weight", seed=seed),
    ])


def balanced_accuracy(predicted: DataFrame) -> float:
    """Balanced accuracy of ``prediction`` against ``label``; 0 without rows."""
    return statistics.scores(predicted, "label", "prediction").first()["balanced_accuracy"] or 0.0


def balanced_accuracies(predicted: DataFrame, tag: str) -> dict:
    """Balanced accuracy for each value of ``tag``, in one job."""
    recall = predicted.groupBy(tag, "label").agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("recall"))
    return {r[tag]: r["score"] for r in recall.groupBy(tag).agg(F.avg("recall").alias("score")).collect()}


def backward_elimination(df: DataFrame, key: str, features: list[str], folds: int = 5, share: float = 0.2, tolerance: float = 0.005, least: int = 1, make: Callable[[list[str]], Pipeline] = forest) -> list[tuple]:
    """(step, n_features, score, features, dropped) of each step; the lowest permutation importances go while the score holds.

    A step's score is the mean balanced accuracy over folds, which are balanced by label. The lowest ``share`` of the
    features go, at least one, ties by name, while the score is within ``tolerance`` of the best so far and more than
    ``least`` features are left. Who lends values to whom is drawn once, for all folds, steps and columns; a fold's test
    rows as they are and with each column permuted are scored in one job, and the folds of a step run side by side.
    """
    dealt = splits.folds(df.select(key, "label", "weight", *features), "label", key, folds).persist()
    sizes = {r["__fold"]: r["count"] for r in dealt.groupBy("__fold").count().collect()}
    groups = F.element_at(F.create_map(*[F.lit(v) for f in range(folds) for v in (f, max(1, sizes.get(f, 0) // PERMUTED_TOGETHER))]), F.col("__fold"))
    lent = partnered(dealt, key, features, F.col("__fold"), groups, ["__fold"]).persist()

    def scored(fold: int, left: list[str]) -> dict:
        model = make(left).fit(dealt.where(F.col("__fold") != fold))
        one = lambda tag: F.struct(F.lit(tag).alias("__tag"), *[(F.col("__other")[c] if c == tag else F.col(c)).alias(c) for c in left])
        tried = lent.where(F.col("__fold") == fold).select(key, "label", "weight", F.inline(F.array(*[one(tag) for tag in ("", *left)])))
        return balanced_accuracies(model.transform(tried), "__tag")

    steps, best, left = [], -1.0, list(features)
    try:
        with ThreadPool(folds) as pool:
            while True:
                found = pool.map(inheritable_thread_target(df.sparkSession)(lambda fold: scored(fold, left)), range(folds))
                scores = [of.get("", 0.0) for of in found]
                losses = {c: sum((s - of.get(c, 0.0)) / folds for s, of in zip(scores, found, strict=True)) for c in left}
                score = float(np.mean(scores))
                best = max(best, score)
                go = sorted(left, key=lambda c: (losses[c], c))[: min(max(1, int(len(left) * share)), len(left) - least)]
                go = go if score >= best - tolerance else []
                steps.append((len(steps), len(left), score, list(left), go))
                if not go:
                    return steps
                left = [c for c in left if c not in go]
    finally:
        lent.unpersist()
        dealt.unpersist()


def principal_components(df: DataFrame, features: list[str], explained: float = 0.95, output: str = "components") -> tuple[DataFrame, list[float]]:
    """``df`` with ``output``, as few principal components of the standardised features as explain that share of their variance, and each one's share."""
    filled = [f"{c}__filled" for c in features]
    model = Pipeline(stages=[
        Imputer(inputCols=features, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="__raw"),
        StandardScaler(inputCol="__raw", outputCol="__scaled", withMean=True), PCA(k=len(features), inputCol="__scaled", outputCol="__all"),
    ]).fit(df)
    shares = [float(v) for v in model.stages[-1].explainedVariance]
    k = min(int(np.searchsorted(np.cumsum(shares), explained - 1e-12)) + 1, len(shares))
    cut = VectorSlicer(inputCol="__all", outputCol=output, indices=list(range(k)))
    return cut.transform(model.transform(df)).drop(*filled, "__raw", "__scaled", "__all"), shares[:k]


def random_search(df: DataFrame, key: str, features: list[str], grid: dict[str, list], tries: int, folds: int = 3, seed: int = 0, make: Callable[..., Pipeline] = forest) -> list[tuple]:
    """(parameters, mean balanced accuracy) of ``tries`` different settings of ``make`` drawn from the grid, best first; all of them if there are fewer."""
    settings = [dict(zip(grid, values, strict=True)) for values in itertools.product(*grid.values())]
    drawn = np.random.default_rng(seed).permutation(len(settings))[:tries]
    dealt = splits.folds(df, "label", key, folds).persist()
    try:
        found = []
        for i in drawn:
            scores = [balanced_accuracy(make(features, **settings[i]).fit(dealt.where(F.col("__fold") != f)).transform(dealt.where(F.col("__fold") == f))) for f in range(folds)]
            found.append((settings[i], float(np.mean(scores))))
        return sorted(found, key=lambda x: -x[1])
    finally:
        dealt.unpersist()
