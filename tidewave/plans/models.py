"""Queries of experiments with random forests: seeds, held-out groups and train sizes, all runs of one in a single job.

A forest has no SQL; the tests hold runs against serial fits, and splits and scores against plain forms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import experiments, forests, statistics
from .features import FEATURES, _samples
from .kernels import TEXT_FEATURES
from .tables import table

Q = {}
SQL: dict[str, str] = {}

#: Fewer trees than the default 500, so that a query ends soon.
FEWER = forests.Settings(trees=60)


def query(f):
    Q[f.__name__] = f
    return f


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of the texts with a label, kept: each seed and side of an experiment reads them again, and texts are long."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", *[F.expr(e).alias(c) for c, e in TEXT_FEATURES.items()])
    return docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id").dropna(subset=["quality"]).persist()


def _by_seed(spark: SparkSession, sf_dir: str, settings: forests.Settings = FEWER) -> DataFrame:
    sided = experiments.seeded(_texts(spark, sf_dir), "quality", "doc_id", 0.8, [1, 2, 3, 4, 5])
    return forests.fitted(sided, ["seed"], "doc_id", "quality", list(TEXT_FEATURES), settings).persist()  # scores read it twice


@query
def forest_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forests that tell the quality label from text statistics, over five stratified splits: mean and spread of the scores."""
    return experiments.over_runs(_by_seed(spark, sf_dir), ["seed"], [], "quality")


@query
def forest_seed_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same runs' scores of each class."""
    return experiments.classes_over_runs(_by_seed(spark, sf_dir), ["seed"], [], "quality")


@query
def forest_seed_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same runs' confusion counts, averaged over seeds."""
    return statistics.mean_confusion(_by_seed(spark, sf_dir), "seed", "quality", "predicted")


@query
def forest_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over principal components that keep 90 % of the variance of the train rows."""
    return experiments.over_runs(_by_seed(spark, sf_dir, forests.Settings(trees=60, explained=0.9)), ["seed"], [], "quality")


@query
def forest_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's labels by forests that know the other languages, over two seeds: the scores of each fold."""
    sided = experiments.held_out(_texts(spark, sf_dir), "lang", [1, 2])
    predicted = forests.fitted(sided, ["fold", "seed"], "doc_id", "quality", list(TEXT_FEATURES), FEWER).persist()
    return experiments.over_runs(predicted, ["fold", "seed"], ["fold"], "quality")


@query
def forest_train_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forests of single users by how many events of each kind they learn from, two draws each: mean and spread over users."""
    sided = experiments.drawn_sides(_samples(spark, sf_dir), ["user_id"], "event_type", "event_id", [2, 4, 6], [0, 1])
    predicted = forests.fitted_runs(sided, ["user_id", "train_size", "seed"], "event_id", "event_type", FEATURES, forests.Settings(trees=20)).persist()
    return experiments.curve(predicted, "user_id", "event_type")
