"""An extension for live recordings: sliding windows over an event stream with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sliding_means(stream: DataFrame, recording: str, t: str, x: str, size: str, hop: str, late: str) -> DataFrame:
    """n and mean of ``x`` for each recording and sliding window; rows later than ``late`` are left out."""
    live = stream.withWatermark(t, late)
    return live.groupBy(F.window(t, size, hop).alias("window"), recording).agg(F.count(x).alias("n"), F.avg(x).alias("mean"))
