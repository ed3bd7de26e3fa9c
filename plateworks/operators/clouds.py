"""Nearest points of clouds in space, exactly and without meeting all of them.

Each cloud is cut along each axis at its own quantiles. A point first asks the cells around its own; one that has found nothing nearer than the
border of those asks again in cells twice as wide, at last in all of the cloud. Quantiles are approximate, which changes the cells but no result.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plateworks.shared import written

AXES = ("x", "y", "z")
#: Cells along an axis are 2 ** FINEST at most; points in a cell, on average, that the first cells aim at.
FINEST, IN_CELL = 6, 16


def _finite(c: str) -> Column:
    return F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False))  # NaN is greater


def _sq(of: str = "t") -> Column:
    each = [(F.col(a) - F.col(f"{of}{a}")) * (F.col(a) - F.col(f"{of}{a}")) for a in AXES]
    return each[0] + each[1] + each[2]


def _bin(axis: str) -> Column:
    """How many of the cuts of the axis are at or below the coordinate."""
    return F.size(F.filter(F.col(f"_cuts_{axis}"), lambda e: e <= F.col(axis)))


def _key(cells: list[Column]) -> Column:
    return (cells[0] * (1 << FINEST) + cells[1]) * (1 << FINEST) + cells[2]


def grid(points: DataFrame, cloud: str) -> DataFrame:
    """(cloud, _top, _cuts of each axis): a row for each cloud. Cuts are 2 ** FINEST - 1; _top is the level, a power of two of cells along an axis, to begin with."""
    cuts = [F.lit(i / (1 << FINEST)) for i in range(1, 1 << FINEST)]
    level = F.floor(F.log2(F.cbrt(F.count("*") / IN_CELL))).cast("int")
    return points.groupBy(cloud).agg(F.greatest(F.lit(1), F.least(F.lit(FINEST), level)).alias("_top"), *[F.percentile_approx(a, F.array(*cuts), F.lit(1000)).alias(f"_cuts_{a}") for a in AXES])


def _kinds(points: DataFrame, cloud: str) -> DataFrame:
    """A point for each way in which a cloud's points are finite, infinite, NaN or null: distances that aren't finite depend on nothing else."""
    return points.select(cloud, *[F.when(_finite(a), 0.0).otherwise(F.col(a)).alias(f"t{a}") for a in AXES]).distinct()


def nearest_sq(asked: DataFrame, points: DataFrame, cloud: str) -> DataFrame:
    """asked (cloud, x, y, z and others) with sq, the squared distance to the nearest of the points (cloud, x, y, z) of its cloud.

    Rows whose cloud has no point are left out. Distances are doubles as SQL gives them: nulls are passed over, NaN is the greatest.
    """
    spark = asked.sparkSession
    whole = reduce(and_, [_finite(a) for a in AXES])
    targets = written(points.where(whole).select(cloud, *AXES).distinct(), "points")
    cells = written(grid(targets, cloud), "grid")
    rows = asked.withColumn("_uid", F.monotonically_increasing_id()).join(cells, cloud, "left")
    bins = [F.when(whole & F.col("_top").isNotNull(), _bin(a)).alias(f"_b{a}") for a in AXES]
    rows = written(rows.select(*asked.columns, "_uid", "_top", *bins), "asked")
    # Those that no finite distance can be told of.
    odd = rows.where("_bx is null").join(_kinds(points, cloud), cloud).groupBy("_uid").agg(F.min(_sq()).alias("sq"))
    placed = written(targets.join(cells, cloud).select(cloud, *[F.col(a).alias(f"t{a}") for a in AXES], *[_bin(a).alias(f"_b{a}") for a in AXES]), "placed")
    open_ = rows.where("_bx is not null").select("_uid", cloud, *AXES, "_bx", "_by", "_bz", F.col("_top").alias("_level"))
    top = cells.agg(F.max("_top")).first()[0] or 0
    found = [odd]
    for _ in range(top):
        shift = F.lit(FINEST) - F.col("_level")
        at = {a: F.expr(f"shiftright(_b{a}, {FINEST} - _level)") for a in AXES}
        most = F.expr("shiftleft(1, _level) - 1")
        beside = [F.sequence(F.greatest(at[a] - 1, F.lit(0)), F.least(at[a] + 1, most)) for a in AXES]
        each = open_.select("_uid", cloud, *AXES, "_level", *[s.alias(f"_s{a}") for a, s in zip(AXES, beside, strict=True)])
        for a in AXES:
            each = each.withColumn(f"_c{a}", F.explode(f"_s{a}")).drop(f"_s{a}")
        each = each.select("_uid", cloud, *AXES, "_level", _key([F.col(f"_c{a}") for a in AXES]).alias("_cell"))
        levels = open_.select(cloud, "_level").distinct()
        there = placed.join(levels, cloud).select(cloud, "tx", "ty", "tz", _key([F.expr(f"shiftright(_b{a}, {FINEST} - _level)") for a in AXES]).alias("_cell"))
        near = each.join(there.hint("merge"), [cloud, "_cell"]).groupBy("_uid").agg(F.min(_sq()).alias("sq"))
        told = open_.join(near, "_uid", "left").join(cells.drop("_top"), cloud)
        gaps = []
        for a in AXES:
            cut = lambda cell, a=a: F.element_at(f"_cuts_{a}", F.call_function("shiftleft", cell, shift))
            gaps += [F.when(at[a] >= 2, F.col(a) - cut(at[a] - 1)), F.when(at[a] + 2 <= most, cut(at[a] + 2) - F.col(a))]
        gap = F.least(*gaps)  # passes over null: no cell on that side
        sure = gap.isNull() | F.coalesce(F.col("sq") <= gap * gap, F.lit(False))
        told = written(told.select(*open_.columns, "sq", sure.alias("_sure")), "told")
        found.append(told.where("_sure").select("_uid", "sq"))
        last = told.where("not _sure")
        if last.isEmpty():
            break
        open_ = last.select("_uid", cloud, *AXES, "_bx", "_by", "_bz", (F.col("_level") - 1).alias("_level"))
    d = reduce(DataFrame.unionByName, found)
    return rows.join(d, "_uid").drop("_uid", "_top", "_bx", "_by", "_bz")
