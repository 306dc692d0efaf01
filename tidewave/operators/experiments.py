"""Experiments: how their settings expand, what their runs are called, which runs they have, and what is reported over runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import evaluation, splits

#: Name parts of settings that differ from their default: setting, default, part. Fixed values of the result files.
SWITCHES = [("tune_hyperparameters", False, "hyp"), ("use_pca", False, "pca"), ("use_pose_derivatives", True, "noderiv"), ("use_time_features", False, "time"), ("include_order", False, "order")]

#: Class settings and what file names call them; fixed values too.
CLASS_PARTS = {"L_vs_H": "LvH", "L_vs_M": "LvM", "M_vs_H": "MvH", "LM_vs_H": "LMvH", "L_vs_MH": "LvMH"}

#: Where each part stands in a folder's name and in a file's.
FOLDER_ORDER = ("noderiv", "time", "zscore", "order", "sampling", "hyp", "pca")
FILE_ORDER = ("hyp", "pca", "noderiv", "time", "zscore", "order")


def expanded(experiments: list[dict], groups: dict[str, object], defaults: dict) -> dict[str, dict]:
    """The full settings of each experiment by name: defaults, its own, and ``files``, what its feature groups stand for. An unknown group is an error."""
    out = {}
    for own in experiments:
        unknown = [g for g in own["feature_groups"] if g not in groups]
        if unknown:
            raise ValueError(f"experiment {own['name']!r} has unknown feature groups {unknown}; there are {sorted(groups)}")
        out[own["name"]] = {**defaults, **own, "files": [groups[g] for g in own["feature_groups"]]}
    return out


def _parts(settings: dict, order: tuple[str, ...]) -> list[str]:
    found = {part: part for name, default, part in SWITCHES if bool(settings.get(name, default)) != default}
    found["zscore"] = "zscore" if settings.get("normalize_features", True) else "nonorm"
    if settings.get("sampling_strategy"):
        found["sampling"] = settings["sampling_strategy"]
    return [found[p] for p in order if p in found]


def folder_name(variant: str, settings: dict) -> str:
    """The folder of all runs with these settings, such as ``original_all_none_zscore``."""
    return "_".join([variant, settings.get("class_config", "all"), settings.get("feature_selection") or "none", *_parts(settings, FOLDER_ORDER)])


def file_suffix(settings: dict) -> str:
    """What follows an experiment's name in its file, such as ``_none_zscore``; empty without settings."""
    if not settings:
        return ""
    classes = CLASS_PARTS.get(settings.get("class_config", "all"))
    return "_" + "_".join([settings.get("feature_selection") or "none", *_parts(settings, FILE_ORDER), *([classes] if classes else [])])


def seeded(df: DataFrame, label: str, key: str, share: float, seeds: list[int]) -> DataFrame:
    """Each row under each ``seed``, with ``side`` by a stratified split."""
    return reduce(DataFrame.unionByName, [splits.stratified(df, label, key, share, seed=s).withColumn("seed", F.lit(s)) for s in seeds])


def held_out(df: DataFrame, group: str, seeds: list[int]) -> DataFrame:
    """Each row under each ``fold`` (a group, whose rows are test) and each ``seed``. Groups without a name are in no fold.

    Rows are copied once for each fold, which is what fitting all folds at once takes.
    """
    folds = [r[group] for r in df.select(group).dropna().distinct().collect()]  # a model each, so they are few
    runs = F.array(*[F.struct(F.lit(f).alias("fold"), F.lit(s).alias("seed")) for f in folds for s in seeds])
    if not folds:
        return df.where("false").withColumns({"fold": F.col(group), "seed": F.lit(0), "side": F.lit("test")})
    met = df.where(F.col(group).isNotNull()).withColumn("__run", F.explode(runs)).select(*df.columns, "__run.*")
    side = F.when(F.col(group) == F.col("fold"), "test").otherwise("train")
    return met.withColumn("side", side)


def drawn_sides(df: DataFrame, keys: list[str], label: str, key: str, sizes: list[int], seeds: list[int]) -> DataFrame:
    """Each row under each ``seed`` and ``train_size``: so many rows of each label, drawn by a hash, are train, the rest test.

    Only where each label that ``df`` has anywhere has more rows than that under the keys; so every run learns all of them.
    """
    labels = df.select(label).dropna().distinct().count()
    known = df.where(F.col(label).isNotNull())
    each = reduce(DataFrame.unionByName, [known.withColumn("seed", F.lit(s)) for s in seeds])
    place = F.row_number().over(Window.partitionBy(*keys, label, "seed").orderBy(splits.spread(F.col(key), 1) * (F.col("seed") + 1) % 1000003, key))
    sized = each.withColumn("__r", place).withColumn("train_size", F.explode(F.array(*[F.lit(s) for s in sizes])))
    fit = known.groupBy(*keys, label).agg(F.count("*").alias("__n")).groupBy(*keys).agg(F.min("__n").alias("__least"), F.count("*").alias("__own"))
    fit = fit.where(F.col("__own") == labels).select(*keys, "__least")
    met = sized.join(fit, keys).where(F.col("train_size") < F.col("__least"))
    return met.withColumn("side", F.when(F.col("__r") <= F.col("train_size"), "train").otherwise("test")).drop("__r", "__least")


METRICS = ("accuracy", "balanced_accuracy", "weighted_f1", "kappa")


def _mean_and_spread(metric: Column | str, name: str) -> list[Column]:
    return [F.avg(metric).alias(f"{name}_mean"), F.stddev_samp(metric).alias(f"{name}_std")]


def over_runs(predicted: DataFrame, keys: list[str], by: list[str], truth: str) -> DataFrame:
    """``by``, runs, and mean and sample sd over runs of each metric of ``fold_scores``; a run has equal ``keys``."""
    scores = evaluation.fold_scores(predicted, keys, truth, "predicted")
    return scores.groupBy(*by).agg(F.count("*").alias("runs"), *[c for m in METRICS for c in _mean_and_spread(m, m)])


def classes_over_runs(predicted: DataFrame, keys: list[str], by: list[str], truth: str) -> DataFrame:
    """``by``, class, and mean and sample sd over runs of precision, recall and f1."""
    found = evaluation.per_class(predicted, keys, truth, "predicted").where("class is not null")
    return found.groupBy(*by, "class").agg(*[c for m in ("precision", "recall", "f1") for c in _mean_and_spread(m, m)])


def curve(predicted: DataFrame, person: str, truth: str) -> DataFrame:
    """train_size, people, and mean, sample sd and standard error over people of the balanced accuracy and the others, each averaged over a person's seeds first."""
    own = evaluation.fold_scores(predicted, [person, "train_size", "seed"], truth, "predicted").groupBy(person, "train_size").agg(*[F.avg(m).alias(m) for m in METRICS])
    spread = [c for m in METRICS for c in (*_mean_and_spread(m, m), F.try_divide(F.stddev_samp(m), F.sqrt(F.count(m).cast("double"))).alias(f"{m}_sem"))]
    return own.groupBy("train_size").agg(F.count("*").alias("people"), *spread)
