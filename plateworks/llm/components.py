"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plateworks.llm.store import checkpointed


def _round(edges: DataFrame) -> DataFrame:
    """One large star and one small star: every vertex and its neighbours move to the least vertex they see."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
    down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for each vertex of the edges (u, v): root is the least vertex of its component.

    The rounds end when all edges lead to roots; their number grows as the logarithm of the longest chain. Each round is
    cut off by a checkpoint. Edges are rows of two numbers; nothing but their number and sum comes to the driver.
    """
    now = checkpointed(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    told = None
    while True:
        # A star forest stays as it is: the same number of edges and the same sums of ends twice running.
        said = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if said == told or not said[0]:
            break
        told, now = said, checkpointed(_round(now))
    return now.select(F.col("u").alias("v"), F.col("v").alias("root")).unionByName(now.select("v", F.col("v").alias("root")).distinct())
