"""Joins of events with intervals of time. An equi key on time buckets keeps range joins from comparing everything."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import groups


def bucketed(starts: DataFrame, answers: DataFrame, key: str, t: str, reach: float, kind: str = "inner") -> DataFrame:
    """Rows of ``starts`` with those of ``answers`` (columns suffixed ``_a``) at t <= t_a <= t + reach."""
    right = answers.select(*[F.col(c).alias(f"{c}_a") for c in answers.columns]).withColumn("__b", F.floor(F.col(f"{t}_a") / reach))
    left = starts.withColumn("__b", F.explode(F.array(F.floor(F.col(t) / reach), F.floor(F.col(t) / reach) + 1)))
    on = (left[key] == right[f"{key}_a"]) & (left["__b"] == right["__b"]) & right[f"{t}_a"].between(left[t], left[t] + reach)
    return left.join(right, on, kind).drop("__b")


def first_match(starts: DataFrame, answers: DataFrame, key: str, t: str, row: str, reach: float) -> DataFrame:
    """For each start its first answer within ``reach`` by (t, row): the start's columns and ``matched`` (struct), NULL if none."""
    pairs = bucketed(starts, answers, key, t, reach)
    best = pairs.groupBy(row).agg(F.min(F.struct(F.col(f"{t}_a").alias("t"), F.col(f"{row}_a").alias("row"))).alias("matched"))
    return starts.join(best, row, "left")


def with_answer(starts: DataFrame, answers: DataFrame, key: str, t: str, reach: float) -> DataFrame:
    """Starts that have an answer within ``reach``, each once, equal ones each. Answers, not starts, lie in two buckets."""
    bucket = F.floor(F.col(t) / reach)
    right = answers.select(F.col(key).alias("__k"), F.col(t).alias("__t"), F.explode(F.array(bucket, bucket - 1)).alias("__b"))
    left = starts.withColumn("__b", bucket)
    on = (left[key] == right["__k"]) & (left["__b"] == right["__b"]) & right["__t"].between(left[t], left[t] + reach)
    return left.join(right, on, "left_semi").drop("__b")


def flagged(samples: DataFrame, intervals: DataFrame, key: str, t: str, start: str, end: str, name: str, bucket: float) -> DataFrame:
    """``name``: whether a sample lies in a closed interval of its key.

    Intervals that meet are merged, so a sample lies in one at most and one left join tells; long ones are cut into buckets.
    """
    order = Window.partitionBy("__k").orderBy("__s", "__e")
    known = intervals.select(F.col(key).alias("__k"), F.col(start).alias("__s"), F.col(end).alias("__e")).where(F.col("__s") <= F.col("__e"))
    before = F.max("__e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = known.withColumn("__new", F.coalesce(F.col("__s") > before, F.lit(True)).cast("int")).withColumn("__i", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy("__k", "__i").agg(F.min("__s").alias("__s"), F.max("__e").alias("__e"))
    cut = merged.withColumn("__b", F.explode(F.sequence(F.floor(F.col("__s") / bucket), F.floor(F.col("__e") / bucket))))
    left = samples.withColumn("__b", F.floor(F.col(t) / bucket))
    on = (left[key] == cut["__k"]) & (left["__b"] == cut["__b"]) & left[t].between(cut["__s"], cut["__e"])
    return left.join(cut.drop("__i"), on, "left").select(*[left[c] for c in samples.columns], F.col("__k").isNotNull().alias(name))


def consumed(df: DataFrame, key: str, t: str, row: str, is_start: Column, is_answer: Column, reach: float) -> DataFrame:
    """Greedy matching in order of time: each start takes the first answer within ``reach`` that no earlier start took.

    Returns key, start row, answer row (NULL if none). An answer goes to the earliest start that still waits, so sorted
    rows stream through a task, which holds no more than the starts of the last ``reach``, however long a recording is.
    Of rows at the same time starts come first. Rows without key or time take no part.
    """
    used = df.select(key, t, row, is_start.alias("s"), is_answer.alias("a")).where("s or a").where(F.col(key).isNotNull() & F.col(t).isNotNull())

    def match(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: deque[tuple] = deque()  # (key, t, row) of starts
        for pdf in parts:
            out = []
            for k, x, r, s, a in zip(*(pdf[c] for c in (key, t, row, "s", "a")), strict=True):
                while waiting and (waiting[0][0] != k or waiting[0][1] + reach < x):
                    own, _, start = waiting.popleft()
                    out.append((own, start, None))
                if s:
                    waiting.append((k, x, r))
                if a and waiting:
                    out.append((k, waiting.popleft()[2], r))
            yield pd.DataFrame(out, columns=[key, "start_row", "answer_row"]).astype({"answer_row": "Int64"})
        yield pd.DataFrame([(k, r, None) for k, _, r in waiting], columns=[key, "start_row", "answer_row"]).astype({"answer_row": "Int64"})

    dealt = used.repartition(key).sortWithinPartitions(key, t, F.col("s").cast("int").desc(), row)
    return dealt.mapInPandas(match, f"{key} {dict(df.dtypes)[key]}, start_row long, answer_row long")


def fixations(df: DataFrame, key: list[str], t: str, x: str, y: str, radius: float, least: float, keep_last: bool = False) -> DataFrame:
    """start, end, duration, x, y of fixations: samples stay within ``radius`` of the one that opened it, for ``least`` seconds.

    The anchor depends on every earlier sample of its group, so this is a fold over sorted samples; groups are windows
    or recordings of bounded length, many to a task. ``keep_last`` also returns a last one that is too short.
    """

    def fold(at: np.ndarray, ax: np.ndarray, ay: np.ndarray) -> list[list]:
        rows: list[tuple] = []
        anchor = None
        for s, a, b in zip(at.tolist(), ax.tolist(), ay.tolist(), strict=True):
            if anchor is None or ((a - anchor[1]) ** 2 + (b - anchor[2]) ** 2) ** 0.5 > radius:
                if anchor is not None and last - anchor[0] >= least:
                    rows.append((anchor[0], last, last - anchor[0], anchor[1], anchor[2]))
                anchor = (s, a, b)
            last = s
        if anchor is not None and (keep_last or last - anchor[0] >= least):
            rows.append((anchor[0], last, last - anchor[0], anchor[1], anchor[2]))
        return [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 5

    samples = df.select(*key, *[F.col(c).cast("double").alias(n) for c, n in ((t, "at"), (x, "ax"), (y, "ay"))])
    known = samples.where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in ("at", "ax", "ay")))
    return groups.applied(known, key, ["at", "ax", "ay"], fold, dict.fromkeys(("start", "end", "duration", "x", "y"), "double"))


def responses(df: DataFrame, key: str, t: str, row: str, is_start: Column, is_answer: Column, follow: str, reach: float) -> DataFrame:
    """For each start its first answer within ``reach``, and ``follow`` of the two rows after that answer in its recording: ``outcome``, ``reaction``.

    The followers are neighbours in the recording as it is, before rows of other kinds are dropped.
    """
    part = Window.partitionBy(key).orderBy(t, row)
    logged = df.withColumns({"outcome": F.lead(follow, 1).over(part), "reaction": F.lead(follow, 2).over(part)})
    answers = logged.where(is_answer).select(key, t, row, "outcome", "reaction")
    pairs = bucketed(df.where(is_start).select(key, t, row), answers, key, t, reach)
    first = F.min_by(F.struct(F.col(f"{row}_a").alias("answer_row"), F.col("outcome_a").alias("outcome"), F.col("reaction_a").alias("reaction")), F.struct(f"{t}_a", f"{row}_a"))
    best = pairs.groupBy(row).agg(first.alias("__m")).select(row, "__m.*")
    return df.where(is_start).select(key, t, row).join(best, row, "left")
