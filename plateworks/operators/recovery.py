"""Detections that dimensions let recover: circles whose diameter is written on the drawing but which no detector saw."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plateworks.operators import kernels

#: How near a detection must be to calibrate by it, how near it must be to count as the circle itself
#: (at least, and as a share of the larger radius), and the radii that are looked for.
CALIBRATES, NEAR, NEAR_SHARE = 15.0, 10.0, 0.4
LEAST_RADIUS, MOST_RADIUS = 3.0, 600.0


def _beside(kept: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Columns x, y, r."""
    return np.hypot(kept[:, 0] - p[0], kept[:, 1] - p[1]) < np.maximum(NEAR, NEAR_SHARE * np.maximum(kept[:, 2], p[2]))


def scales(detections: DataFrame, anchors: DataFrame, by: str) -> DataFrame:
    """(by, scale): the median over anchors of the smallest radius detected near one, over half its value. Drawings without such an anchor have none."""
    d = detections.select(by, F.col("x").alias("dx"), F.col("y").alias("dy"), F.col("r").alias("dr"))
    dx, dy = F.col("dx") - F.col("x"), F.col("dy") - F.col("y")
    near = anchors.where("value > 0").join(d, by).where(F.sqrt(dx * dx + dy * dy) < CALIBRATES)
    votes = near.groupBy(by, "no").agg((F.min("dr") / (F.first("value") / 2)).alias("vote"))
    return votes.groupBy(by).agg(F.median("vote").alias("scale"))


def recovered(detections: DataFrame, anchors: DataFrame, by: str) -> DataFrame:
    """(by, no, x, y, r) of the circles to append: anchors (by, no, x, y, value) that no detection (by, x, y, r) stands for.

    The radius is half the value at the drawing's scale. Anchors go in the order of ``no``; one that was appended counts as a
    detection for those after it. Anchors with a null or non-positive value, or a radius out of range, and drawings without a scale give none.
    """
    a = anchors.join(scales(detections, anchors, by), by).withColumn("r", F.col("value") / 2 * F.col("scale")).where(F.col("r").between(LEAST_RADIUS, MOST_RADIUS))
    d = detections.select(F.col(by).alias("_by"), F.col("x").alias("dx"), F.col("y").alias("dy"), F.col("r").alias("dr"))
    dx, dy = F.col("dx") - F.col("x"), F.col("dy") - F.col("y")
    seen = (F.col("_by") == F.col(by)) & (F.sqrt(dx * dx + dy * dy) < F.greatest(F.lit(NEAR), NEAR_SHARE * F.greatest("r", "dr")))
    missed = a.join(d, seen, "left_anti").select(by, "no", "x", "y", "r")
    return kernels.suppressed(missed, [by], ["no"], _beside, ["x", "y", "r"])
