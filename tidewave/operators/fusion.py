"""Lookups of conditions, fusion of feature tables, and what fused tables need before a model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def condition_map(info: DataFrame, participant: str, sessions: list[str]) -> DataFrame:
    """participant, trial, condition from one row a participant: the first letter of each session's code; empty and ``-`` are no session."""
    long = info.select(F.col(participant).cast("string").alias("participant"), F.expr(f"stack({len(sessions)}, " + ", ".join(f"{i}, `{s}`" for i, s in enumerate(sessions, 1)) + ") as (trial, code)"))
    code = F.trim("code")
    return long.where(code.isNotNull() & ~code.isin("", "-")).select("participant", "trial", F.substring(code, 1, 1).alias("condition"))


#: Numbers of session orders, fixed values of the result tables: of studies with two orders, and with all six.
TWO_ORDERS = {"LMH": 1, "LHM": 2}
SIX_ORDERS = {"LMH": 1, "LHM": 2, "MLH": 3, "MHL": 4, "HLM": 5, "HML": 6}


def session_order(info: DataFrame, participant: str, sessions: list[str], numbers: dict[str, int]) -> DataFrame:
    """participant, session_order (the first letters of the sessions' codes) and session_order_numeric, NULL for an order without a number; NULL codes give none."""
    order = F.concat(*[F.substring(F.col(f"`{s}`"), 1, 1) for s in sessions])
    number = F.create_map(*[F.lit(v) for pair in numbers.items() for v in pair])
    return info.select(F.col(participant).alias("participant"), order.alias("session_order"), F.try_element_at(number, order).alias("session_order_numeric"))


def with_condition(df: DataFrame, conditions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with their condition, and the rejected ones that have none."""
    met = df.join(conditions, ["participant", "trial"], "left")  # conditions are never NULL
    return met.where("condition is not null"), met.where("condition is null").drop("condition")


def fuse(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """Inner join of feature tables on their common keys; of columns with the same name the leftmost table's stays."""

    def join(left: DataFrame, right: DataFrame) -> DataFrame:
        on = [k for k in keys if k in left.columns and k in right.columns]
        if not on:
            raise ValueError("tables without a common key")
        return left.join(right.select(*on, *[c for c in right.columns if c not in left.columns]), on)

    return reduce(join, tables)


def time_features(df: DataFrame, keys: list[str], index: str) -> DataFrame:
    """``time_own`` and ``time_all``: the index from 0 to 1 within its keys and within all; 0.5 where it doesn't vary."""
    part = Window.partitionBy(*keys)
    low, high = F.min(index).over(part), F.max(index).over(part)
    ends = df.agg(F.min(index).alias("lo"), F.max(index).alias("hi")).first()
    share = lambda lo, hi: F.coalesce(F.try_divide((F.col(index) - lo).cast("double"), (hi - lo).cast("double")), F.lit(0.5))
    return df.withColumns({"time_own": share(low, high), "time_all": share(F.lit(ends["lo"]), F.lit(ends["hi"]))})


def one_hot(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    return df.withColumns({f"{column}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in values})


def merged_classes(df: DataFrame, column: str, classes: dict[str, list[str]]) -> DataFrame:
    """Rows whose class is in one of the lists, under the list's name."""
    name = reduce(lambda c, kv: c.when(F.col(column).isin(kv[1]), kv[0]), classes.items(), F)
    return df.withColumn(column, name).where(F.col(column).isNotNull())


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key isn't among them; columns that one side lacks are NULL."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def without_empty(df: DataFrame) -> DataFrame:
    """``df`` without the columns that are NULL in every row; one aggregate over all columns finds them."""
    known = df.agg(*[F.count(F.col(f"`{c}`")).alias(str(i)) for i, c in enumerate(df.columns)]).first()
    return df.select(*[F.col(f"`{c}`") for i, c in enumerate(df.columns) if known[i]])


def without_brackets(df: DataFrame) -> DataFrame:
    """Text columns without square brackets."""
    return df.withColumns({c: F.regexp_replace(f"`{c}`", r"[\[\]]", "") for c, kind in df.dtypes if kind == "string"})


def columns_first(df: DataFrame, first: list[str]) -> DataFrame:
    """The named columns that are there come first."""
    head = [c for c in first if c in df.columns]
    return df.select(*head, *[c for c in df.columns if c not in head])
