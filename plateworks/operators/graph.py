"""Walks over parents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plateworks.shared import checkpointed


def walks(nodes: DataFrame) -> DataFrame:
    """(id, depth, in_cycle) for the nodes (id, parent) that have a parent: steps to the end of the walk, null if it never ends.

    Pointers are doubled: after j rounds a node knows its ancestor 2^j steps up. A walk that is still under way after more steps than
    there are nodes has met one twice. A parent that is no node ends the walk. Walks that have ended take no part in later joins but as what others reach.
    """
    at = checkpointed(nodes.select("id", F.col("parent").alias("at"), F.col("parent").isNotNull().cast("long").alias("depth")))
    ended = at.where("at is null")
    open_ = at.where("at is not null")
    for _ in range(at.count().bit_length()):
        if open_.isEmpty():
            break
        up = ended.unionByName(open_).select(F.col("id").alias("at"), F.col("at").alias("_at"), F.col("depth").alias("_d"))
        now = checkpointed(open_.join(up, "at", "left").select("id", F.col("_at").alias("at"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth")))
        ended, open_ = ended.unionByName(now.where("at is null")), now.where("at is not null")
    whole = ended.unionByName(open_).where("depth > 0")
    ends = F.col("at").isNull()
    return whole.select("id", F.when(ends, F.col("depth")).alias("depth"), (~ends).alias("in_cycle"))
