"""Plane geometry as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sheet scales, largest first.
SHEET_SCALES = (10.0, 5.0, 4.0, 2.5, 2.0, 1.0, 0.5, 0.4, 0.25, 0.2, 0.1, 0.05)


def to_part_frame(px: Column, origin: float, sign: int, per_mm: float) -> Column:
    """Pixels to millimetres along one axis of a view."""
    return sign * (px - origin) / per_mm


def affine(x: Column, y: Column, degrees: float, scale: float, tx: float, ty: float, cx: float, cy: float, sign: int = -1) -> tuple[Column, Column]:
    """Rotation about a centre, scale and shift. sign -1 rotates as the generator of scans does, 1 as the scorer does."""
    t = math.radians(sign * degrees)
    c, s = math.cos(t), math.sin(t)
    dx, dy = x - cx, y - cy
    return scale * (dx * c - dy * s) + cx + tx, scale * (dx * s + dy * c) + cy + ty


def turn(degrees: Column) -> Column:
    """An angle in [0, 360)."""
    return F.pmod(degrees, F.lit(360.0))


def swept_angles(start: Column, mid: Column, end: Column) -> tuple[Column, Column]:
    """(start, end) of an arc, in increasing direction, that goes through mid."""
    to_mid, to_end = turn(mid - start), turn(end - start)
    straight = to_mid <= to_end
    return F.when(straight, turn(start)).otherwise(turn(end)), F.when(straight, turn(end)).otherwise(turn(start))


def quantized(value: Column, extent: Column, n: int) -> Column:
    """The grid number of a coordinate: one step for all views, halves to even."""
    return F.rint(value / (extent / (n - 1))).cast("long")


def principal_axes(ux: Column, uy: Column, vx: Column, vy: Column) -> tuple[Column, Column, Column]:
    """Major and minor radius and rotation (degrees, [0, 180)) of the ellipse with two conjugate radii."""
    t = F.atan2(2 * (ux * vx + uy * vy), ux * ux + uy * uy - vx * vx - vy * vy) / 2
    c, s = F.cos(t), F.sin(t)
    ax, ay, bx, by = ux * c + vx * s, uy * c + vy * s, -ux * s + vx * c, -uy * s + vy * c
    return F.sqrt(ax * ax + ay * ay), F.sqrt(bx * bx + by * by), F.pmod(F.degrees(F.atan2(ay, ax)), F.lit(180.0))


def projected(view: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """A point in the plane of the front, top or right view; null for other views."""
    u = F.when(view.isin("front", "top"), x).when(view == "right", y)
    v = F.when(view.isin("front", "right"), z).when(view == "top", y)
    return u, v


def tile_starts(extent: Column, tile: int, overlap: float) -> Column:
    """Where overlapping tiles begin, evenly spread, the last one ending at the extent."""
    stride = max(1, round(tile * (1 - overlap)))
    n = F.ceil((extent - tile) / stride) + 1
    starts = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.least(F.rint(i * (extent - tile) / (n - 1)).cast("long"), extent - tile))
    return F.when(extent <= tile, F.array(F.lit(0).cast("long"))).otherwise(starts)


def tiles(width: Column, height: Column, tile: int, overlap: float) -> Column:
    """The tiles of a sheet, row by row, as struct<i, x0, y0, x1, y1>."""
    xs, ys = tile_starts(width, tile, overlap), tile_starts(height, tile, overlap)
    boxes = F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: F.struct(x.alias("x0"), y.alias("y0"), F.least(x + tile, width).alias("x1"), F.least(y + tile, height).alias("y1")))))
    return F.transform(boxes, lambda b, i: F.struct(i.cast("long").alias("i"), *[b[c].alias(c) for c in ("x0", "y0", "x1", "y1")]))



def sheet_scale(width: Column, height: Column, room_w: float, room_h: float) -> Column:
    """The largest nice scale at which both sides fit, else the smallest."""
    fits = [F.when((width * s <= room_w) & (height * s <= room_h), F.lit(s)) for s in SHEET_SCALES]
    return F.coalesce(*fits, F.lit(SHEET_SCALES[-1]))
