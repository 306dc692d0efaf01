"""Tables as the queries see them: events as recordings of users, with seconds since the start of 2024."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86_400.0
START = 1_704_067_200_000_000

#: The same as SQL.
EVENTS = f"e AS (SELECT event_id, user_id, event_type, value, (epoch_us(ts) - {START}) / 1e6 AS t FROM events)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(START)).cast("double") / 1e6
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", t.alias("t"))


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})
