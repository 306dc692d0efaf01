"""Train and test splits without leaks. All are rankings by a hash or by time, so they are repeatable and distributed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spread(key: Column, seed: int) -> Column:
    """A repeatable shuffle position of a whole number, plain arithmetic that any engine has."""
    return (key.cast("long") * 2654435761 + seed * 40503) % 4294967296


#: Parts of the hash's range that are ranked apart; a task sorts about that share of a group.
PARTS = 64


def ranked(df: DataFrame, keys: list[str], key: str, seed: int) -> DataFrame:
    """``__rank`` (from 1) by hash among the rows with equal ``keys``, and ``__of``, their number.

    The range of the hash is cut into parts that are ranked apart; what lies before a part comes from its counts. So a
    group as large as the table is ranked by many tasks.
    """
    at = spread(F.col(key), seed)
    own = df.withColumns({"__at": at, "__part": F.floor(at / F.lit(4294967296.0 / PARTS)).cast("int")})
    counts = own.groupBy(*keys, "__part").agg(F.count("*").alias("__n"))
    whole = Window.partitionBy(*keys)  # PARTS rows at most
    before = counts.withColumns({"__before": F.sum("__n").over(whole.orderBy("__part")) - F.col("__n"), "__of": F.sum("__n").over(whole)}).drop("__n")
    on = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys] + [F.col("x.__part") == F.col("y.__part")]
    met = own.alias("x").join(before.alias("y"), reduce(lambda a, b: a & b, on)).select("x.*", "y.__before", "y.__of")
    place = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy("__at", key))
    return met.withColumn("__rank", F.col("__before") + place).drop("__before", "__at", "__part")


def stratified(df: DataFrame, label: str, key: str, share: float, seed: int = 0) -> DataFrame:
    """``side``: of each label the first ``share`` by hash are train."""
    found = ranked(df, [label], key, seed)
    return found.withColumn("side", F.when(F.col("__rank") <= F.floor(F.col("__of") * F.lit(share)), "train").otherwise("test")).drop("__rank", "__of")


def by_group(df: DataFrame, group: str, share: float, seed: int = 0) -> DataFrame:
    """``side``: the first max(1, floor(share n)) of the groups by hash are test, whole."""
    found = ranked(df.select(group).distinct(), [], group, seed)
    test = found.where(F.col("__rank") <= F.greatest(F.lit(1), F.floor(F.col("__of") * F.lit(share)))).select(group, F.lit(True).alias("__test"))
    return df.join(test, group, "left").withColumn("side", F.when(F.col("__test"), "test").otherwise("train")).drop("__test")


def folds(df: DataFrame, label: str, key: str, n: int, seed: int = 7) -> DataFrame:
    """``__fold``: 0 to n - 1, dealt in turn by hash within each label."""
    return ranked(df, [label], key, seed).withColumn("__fold", (F.col("__rank") % n).cast("int")).drop("__rank", "__of")


def folds_by_group(df: DataFrame, group: str) -> DataFrame:
    """``fold``: 0, 1, ... by group, one group a fold. The groups are ranked in one task, not the rows: each is a model to fit."""
    ranked = df.select(group).distinct().withColumn("fold", F.dense_rank().over(Window.orderBy(group)) - 1)
    return df.join(ranked, group)


def temporal(df: DataFrame, keys: list[str], order: list[str], n: int, buffer: int = 1) -> DataFrame:
    """``side``: of each key the first ``n`` in time are train, the next ``buffer`` neither, the rest test; keys too short for a test row go."""
    part = Window.partitionBy(*keys)
    rank = F.row_number().over(part.orderBy(*order))
    side = F.when(F.col("__r") <= n, "train").when(F.col("__r") > n + buffer, "test")
    return df.withColumns({"__r": rank, "__n": F.count("*").over(part)}).where(F.col("__n") >= n + buffer + 1).withColumn("side", side).where("side is not null").drop("__r", "__n")


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """``weight``: rows / (classes times rows of the class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("__c"))
    total = counts.agg(F.sum("__c").alias("n"), F.count("*").alias("k")).first()
    return df.join(counts, label).withColumn("weight", F.lit(float(total["n"] or 0)) / (F.lit(float(total["k"] or 1)) * F.col("__c"))).drop("__c")


def first_of(df: DataFrame, keys: list[str], order: list[Column | str], n: int) -> DataFrame:
    """``side``: of each key the first ``n`` in the order are train, the rest test. Order by time, or by ``spread`` for a random draw."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("side", F.when(rank <= n, "train").otherwise("test"))
