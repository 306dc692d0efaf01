"""Connected components of links, by shuffles alone; no task or driver holds a whole component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import looked_up, stored


def roots(links: DataFrame) -> DataFrame:
    """(u, v) for each end of a link that isn't the smallest of its component; v is the smallest. Links have columns u > v.

    First each node with several smaller neighbours keeps the smallest and hands the others on to it, until each node
    has one: a forest. Then each node takes its parent's parent, which halves the depth, until nothing moves. Both end
    in a written table for each round. Nodes with very many links find their entry by a broadcast. No links give no rows.
    """
    edges = stored(links.select("u", "v").distinct())
    while True:
        least = stored(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        several = least.where("n > 1")
        if not (size := several.count()):
            break
        others = looked_up(edges, several, ["u"], "n", size=size).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(least.select("u", F.col("m").alias("v")).union(others).distinct())
    while True:
        children = edges.groupBy("v").agg(F.count("*").alias("n"))
        up = stored(children.join(edges.select(F.col("u").alias("v"), F.col("v").alias("w")), "v"))
        if not (size := up.count()):
            return edges
        edges = stored(looked_up(edges, up, ["v"], "n", "left", size=size).select("u", F.coalesce("w", "v").alias("v")))
