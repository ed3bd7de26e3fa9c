"""Targets of a detector of circles: a heat map with a peak at each centre, and radii in the cells beside it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spread of a peak (in cells at least, and as a share of the radius), and how many spreads of it are kept.
SPREAD, SHARE, REACH = 1.0, 0.3, 3.0
#: Side of a block of cells.
BLOCK = 64


def targets(circles: DataFrame, by: Sequence[str], *, width: int, height: int, stride: int, code: Callable[[Column], Column] = lambda r: F.ln(F.greatest(r, F.lit(1.0)))) -> DataFrame:
    """(by, iy, ix, heat, radius, centre): the cells of maps of width by height cells that circles (by, x, y, r in pixels) warm.

    A circle gives each cell within REACH spreads exp(-d^2 / (2 spread^2)), and 1 to the cell of its centre; a cell has the most that any gives it;
    what is left out is below exp(-REACH^2 / 2). The cells around a centre have the code of its radius; the largest of several. Circles whose centre
    lies outside the map, or with nulls, give nothing. Circles, not cells, are dealt out, to the blocks of their map that they warm; a map larger than a
    block has several tasks, and a block's cells are merged where they arise.
    """
    gx, gy = F.col("x") / stride, F.col("y") / stride
    inside = (gx >= 0) & (gx < width) & (gy >= 0) & (gy < height) & F.col("r").isNotNull()
    c = circles.where(inside).select(*by, gx.alias("gx"), gy.alias("gy"), "r", F.greatest(F.lit(SPREAD), F.col("r") / stride * SHARE).alias("s"))

    def low(at: str) -> Column:
        return F.greatest(F.lit(0), F.ceil(F.col(at) - REACH * F.col("s")).cast("int"))

    def high(at: str, most: int) -> Column:
        return F.least(F.lit(most - 1), F.floor(F.col(at) + REACH * F.col("s")).cast("int"))

    def cells(at: str, most: int, block: str) -> Column:
        first = F.col(block) * BLOCK
        return F.explode(F.sequence(F.greatest(low(at), first), F.least(high(at, most), first + BLOCK - 1)))

    blocks = lambda at, most: F.explode(F.sequence(F.floor(low(at) / BLOCK).cast("int"), F.floor(high(at, most) / BLOCK).cast("int")))
    c = c.withColumn("_by", blocks("gy", height)).withColumn("_bx", blocks("gx", width)).repartition(*by, "_by", "_bx")
    middle = lambda at, most: F.least(F.rint(F.col(at)).cast("int"), F.lit(most - 1))
    c = c.select("*", middle("gy", height).alias("cy"), middle("gx", width).alias("cx"), code(F.col("r")).alias("code"))
    warm = c.withColumn("iy", cells("gy", height, "_by")).withColumn("ix", cells("gx", width, "_bx"))
    dy, dx = F.col("iy") - F.col("gy"), F.col("ix") - F.col("gx")
    # REACH spreads are more than the cells beside a centre, so those are all among the warm ones.
    oy, ox = F.abs(F.col("iy") - F.col("cy")), F.abs(F.col("ix") - F.col("cx"))
    own = (oy == 0) & (ox == 0)
    heat = F.when(own, 1.0).otherwise(F.exp(-(dy * dy + dx * dx) / (2 * F.col("s") * F.col("s"))))
    warm = warm.select(*by, "_by", "_bx", "iy", "ix", heat.alias("heat"), F.when((oy <= 1) & (ox <= 1), F.col("code")).alias("radius"), own.alias("centre"))
    done = warm.groupBy(*by, "_by", "_bx", "iy", "ix").agg(F.max("heat").alias("heat"), F.max("radius").alias("radius"), F.bool_or("centre").alias("centre"))
    return done.select(*by, F.col("iy").cast("long").alias("iy"), F.col("ix").cast("long").alias("ix"), "heat", "radius", "centre")
