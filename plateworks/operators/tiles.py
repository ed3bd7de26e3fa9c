"""Drawings of overlapping tiles put together: primitives found twice become one, and references follow."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plateworks.operators import kernels, selection

#: How far ends and centres may be apart, and radii (at least, and as a share of the one kept).
APART, RADIUS, RADIUS_SHARE = 20.0, 8.0, 0.2


def _same(kept: np.ndarray, p: np.ndarray) -> np.ndarray:
    """For all pairs of points that stay and points that come. Columns: whether it is a line, its ends x1, y1, x2, y2, or else the centre twice, and the radius."""
    far = lambda i, j: np.hypot(kept[:, i] - p[j], kept[:, i + 1] - p[j + 1]) < APART
    line = (far(1, 1) & far(3, 3)) | (far(1, 3) & far(3, 1))
    curve = far(1, 1) & (np.abs(kept[:, 5] - p[5]) < np.maximum(RADIUS, RADIUS_SHARE * kept[:, 5]))
    return (kept[:, 0] == p[0]) & np.where(kept[:, 0] == 1, line, curve)


def shifted(prims: DataFrame) -> DataFrame:
    """Primitives of tiles (x0, y0: the tile's corner) in the coordinates of the sheet. Lines have x1 to y2, circles and arcs x1, y1 and r."""
    line = F.col("type") == "line"
    return prims.withColumns(
        {"x1": F.col("x1") + F.col("x0"), "y1": F.col("y1") + F.col("y0"), "x2": F.when(line, F.col("x2") + F.col("x0")), "y2": F.when(line, F.col("y2") + F.col("y0"))}
    )


def merged(prims: DataFrame, sheet: str) -> DataFrame:
    """prims (sheet, tile, ord, id, type, x1, y1, x2, y2, r in sheet coordinates) with ``kept``: struct<tile, id> of the one that stands for each.

    In the order of tiles, and of ``ord`` within one, a primitive stays unless one that stays before it is the same: a line whose ends are near, in
    either direction, or a circle or arc near in centre and radius. A null radius is 0; other types than lines, circles and arcs stay.
    """
    line, curve = F.col("type") == "line", F.col("type").isin("circle", "arc")
    # Any other type is of a sort of its own, which no point is near to.
    kind = F.when(line, 1.0).when(curve, 2.0).otherwise(F.lit(float("nan")))
    at = {"_k": kind, "_a": F.col("x1"), "_b": F.col("y1"), "_c": F.when(line, F.col("x2")).otherwise(F.col("x1")), "_d": F.when(line, F.col("y2")).otherwise(F.col("y1")), "_r": F.coalesce("r", F.lit(0.0))}
    names = prims.columns
    marked = prims.withColumns({k: c.cast("double") for k, c in at.items()}).withColumn("_name", F.struct("tile", "id"))
    done = kernels.first_kept(marked, [sheet], ["tile", "ord"], _same, list(at), "_name")
    return done.select(*names, "kept")


def remapped(dims: DataFrame, prims: DataFrame, sheet: str) -> DataFrame:
    """(sheet, no, tile, ord, kind, value, refs, n_merged) of the annotations (sheet, tile, ord, kind, value, refs: ids within the tile) over merged primitives.

    References become struct<tile, id> of what stands for them, in their order; those that lead nowhere are dropped. Of annotations with
    one kind, value (to one decimal) and set of references the first stays; they are numbered anew from 1. Without a value it is 0.
    """
    known = prims.select(sheet, "tile", F.col("id").alias("_id"), "kept").dropDuplicates([sheet, "tile", "_id"])
    value = F.coalesce(F.col("value").cast("double"), F.lit(0.0))
    d = dims.select(sheet, "tile", "ord", "kind", value.alias("value"), F.posexplode_outer("refs").alias("_pos", "_id"))
    d = d.join(known.hint("merge"), [sheet, "tile", "_id"], "left").groupBy(sheet, "tile", "ord", "kind", "value")
    d = d.agg(F.array_sort(F.collect_list(F.when(F.col("kept").isNotNull(), F.struct("_pos", "kept")))).alias("_r"))
    d = d.select(sheet, "tile", "ord", "kind", "value", F.transform("_r", lambda r: r["kept"]).alias("refs"))
    row = F.struct("tile", "ord", "value", "refs")
    first = d.groupBy(sheet, F.coalesce("kind", F.lit("")).alias("_kind"), F.rint(F.col("value") * 10).alias("_v"), F.array_sort(F.array_distinct("refs")).alias("_set"))
    first = first.agg(F.first("kind").alias("kind"), F.min_by(row, F.struct("tile", "ord")).alias("_f"), F.count("*").alias("n_merged")).select(sheet, "kind", "_f.*", "n_merged")
    return selection.numbered(first, [sheet], ["tile", "ord"], "no").select(sheet, "no", "tile", "ord", "kind", "value", "refs", "n_merged")
