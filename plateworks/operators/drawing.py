"""Operators on primitives of drawings: tags, merges, ranks, coverage, tolerance joins.

All take columns by name or expressions. Joins have the drawing and view as equality, so that only what is left of a condition is a theta
join inside one view.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged(df: DataFrame, key: Sequence[str], order: str, ids: str, tags: str | None = None) -> DataFrame:
    """One row for each key: the first by order, all ids in order and, if asked for, the distinct tags in order."""
    row = F.struct(F.col(order).alias("o"), F.col(ids).alias("id"), *([F.col(tags).alias("tag")] if tags else []))
    g = df.groupBy(*key).agg(F.sort_array(F.collect_list(row)).alias("_r"))
    out = g.select(*key, F.col("_r")[0]["o"].alias(f"first_{order}"), F.transform("_r", lambda x: x["id"]).alias(ids), "_r")
    if tags:
        out = out.withColumn(tags, F.array_distinct(F.transform("_r", lambda x: x["tag"])))
    return out.drop("_r")


def covered(length: Column, intervals: Column, tol: float) -> Column:
    """Whether [0, length] lies in the union of (a, b) intervals, widened by tol and sorted by where they begin.

    The reach stays where it is at a gap; later intervals begin past it too.
    """
    reach = F.aggregate(F.sort_array(intervals), F.lit(0.0), lambda cur, iv: F.when(iv["a"] <= cur + tol, F.greatest(cur, iv["b"])).otherwise(cur))
    return (length >= tol) & (F.size(intervals) > 0) & (reach >= length - tol)


def nearest(left: DataFrame, right: DataFrame, on: Sequence[str], key: Sequence[str], distance: Column, accept: Column, pick: str, tie: str) -> DataFrame:
    """For each key the pick of the nearest row on the right that is accepted, ties by the lesser tie; null if none is."""
    near = left.join(right, list(on)).where(accept).groupBy(*key).agg(F.min_by(pick, F.struct(distance, F.col(tie))).alias(pick))
    return left.select(*key).join(near, list(key), "left")


def swept(x: Column, low: Column, high: Column) -> Column:
    """Distance of x from the interval [low, high]."""
    return F.greatest(low - x, x - high, F.lit(0.0))


def shown_elsewhere(df: DataFrame, drawing: str, view: str, row: str, tags: str, asked: Column, visible: Column) -> DataFrame:
    """The rows ``asked`` for all of whose tags are on a visible row of the drawing, but on none of the row's own view. Rows without tags are none.

    A row is known by (drawing, row). Tags shown in a drawing and in each of its views come by windows: rows that lie together by drawing are not moved again.
    """
    shown = F.when(visible, F.col(tags))
    # Visible rows of an unknown view show their tags, but in no view that could be a row's own.
    d = df.withColumns({"_asked": F.coalesce(asked, F.lit(False)), "_mine": F.collect_set(shown).over(Window.partitionBy(drawing, view)), "_all": F.collect_set(shown).over(Window.partitionBy(drawing))})
    known = F.filter(F.array_distinct(F.flatten("_all")), lambda t: t.isNotNull())
    fails = F.col(drawing).isNull() | F.col(row).isNull() | F.col(view).isNull() | (F.size(F.array_except(tags, known)) > 0) | F.coalesce(F.arrays_overlap(tags, F.flatten("_mine")), F.lit(False))
    d = d.where("_asked").where(F.size(tags) > 0).withColumn("_fails", fails)
    return d.withColumn("_any", F.max("_fails").over(Window.partitionBy(drawing, row))).where("not _any").select(df.columns)
