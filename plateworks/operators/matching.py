"""Drawn primitives against the primitives that a solid predicts, through cells of a grid.

Each side lies in the cells that it touches, and a drawn one asks with one point of it, so that pairs meet once, and only near ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How far a point may lie from a segment or a centre, and radii of circles and of ellipses from each other.
POINT, RADIUS, AXIS = 1e-3, 1e-3, 1e-2
CELL = 8.0


def on_segment(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column, tol: float = POINT) -> Column:
    """Whether a point lies within tol of a segment; along it, tol is a share of its length. Of a segment without length, whether it is near its end."""
    dx, dy = x2 - x1, y2 - y1
    square = dx * dx + dy * dy
    t = ((x - x1) * dx + (y - y1) * dy) / F.nullif(square, F.lit(0.0))
    beside = F.hypot(x - (x1 + t * dx), y - (y1 + t * dy)) < tol
    return F.when(square < 1e-6, F.hypot(x - x1, y - y1) < tol).otherwise(F.coalesce((t >= -tol) & (t <= 1 + tol) & beside, F.lit(False)))


def segment_cells(x1: Column, y1: Column, x2: Column, y2: Column, cell: float = CELL, tol: float = POINT) -> Column:
    """The cells (i, j) that a segment and what lies within tol of it touch: column by column, the rows between where it enters and leaves."""
    slack = tol * (1 + F.hypot(x2 - x1, y2 - y1))
    low, high = F.least(x1, x2) - slack, F.greatest(x1, x2) + slack
    slope = (y2 - y1) / F.nullif(x2 - x1, F.lit(0.0))

    def rows(i: Column) -> Column:
        a, b = F.greatest(i * cell, low), F.least((i + 1) * cell, high)
        # Of a steep segment all its height, else what lies over the column.
        at = lambda x: F.coalesce(y1 + (x - x1) * slope, y1)
        bottom, top = F.least(at(a), at(b)), F.greatest(at(a), at(b))
        steep = slope.isNull() | (F.abs(slope) > 1e3)
        bottom, top = F.when(steep, F.least(y1, y2)).otherwise(bottom) - slack, F.when(steep, F.greatest(y1, y2)).otherwise(top) + slack
        js = F.sequence(F.floor(bottom / cell).cast("long"), F.floor(top / cell).cast("long"))
        return F.transform(js, lambda j: F.struct(i.alias("i"), j.alias("j")))

    return F.flatten(F.transform(F.sequence(F.floor(low / cell).cast("long"), F.floor(high / cell).cast("long")), rows))


def around(x: Column, y: Column, cell: float = CELL, tol: float = POINT) -> Column:
    """The cells within tol of a point: one to four."""
    span = lambda v: F.sequence(F.floor((v - tol) / cell).cast("long"), F.floor((v + tol) / cell).cast("long"))
    return F.flatten(F.transform(span(x), lambda i: F.transform(span(y), lambda j: F.struct(i.alias("i"), j.alias("j")))))


def origins(drawn: DataFrame, predicted: DataFrame, by: list[str], key: str) -> DataFrame:
    """(by, key, origins) of the drawn primitives that match one: the ids of all that match, each once, in the order in which ``ord`` first has it.

    drawn: by, key, type (line, polyline, circle, arc, ellipse), pts array<array<double>>, cx, cy, r, rmaj, rmin. predicted: by, ord, ids array, type
    (line, circle, arc, ellipse), x1, y1, x2, y2, cx, cy, r, rmaj, rmin. Lines and polylines match a line on which all their points lie; circles and
    arcs one with the same centre and radius, ellipses one with the same centre and axes. Null geometry matches nothing.
    """
    line, conic = F.col("type") == "line", F.col("type").isin("circle", "arc", "ellipse")
    straight = F.col("type").isin("line", "polyline")
    sort = lambda c: F.when(c.isin("line", "polyline"), "line").when(c == "ellipse", "ellipse").when(c.isin("circle", "arc"), "circle")
    own = F.when(straight & (F.size("pts") > 0), F.struct(F.floor(F.col("pts")[0][0] / CELL).cast("long").alias("i"), F.floor(F.col("pts")[0][1] / CELL).cast("long").alias("j")))
    own = own.when(conic, F.struct(F.floor(F.col("cx") / CELL).cast("long").alias("i"), F.floor(F.col("cy") / CELL).cast("long").alias("j")))
    d = drawn.select(*by, key, sort(F.col("type")).alias("_sort"), "pts", "cx", "cy", "r", "rmaj", "rmin", own.alias("_cell"))
    cells = F.when(line, segment_cells(*[F.col(c) for c in ("x1", "y1", "x2", "y2")])).when(conic, around(F.col("cx"), F.col("cy")))
    p = predicted.select(*by, "ord", "ids", sort(F.col("type")).alias("_sort"), "x1", "y1", "x2", "y2", *[F.col(c).alias(f"_{c}") for c in ("cx", "cy", "r", "rmaj", "rmin")], F.explode(cells).alias("_cell"))
    pairs = d.join(p, [*by, "_sort", "_cell"])
    ends = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    lies = F.forall("pts", lambda q: on_segment(q[0], q[1], *ends))
    centre = F.hypot(F.col("cx") - F.col("_cx"), F.col("cy") - F.col("_cy")) < POINT
    near = lambda c, tol: F.abs(F.col(c) - F.col(f"_{c}")) < tol
    match = F.when(F.col("_sort") == "line", lies).when(F.col("_sort") == "circle", centre & near("r", RADIUS)).otherwise(centre & near("rmaj", AXIS) & near("rmin", AXIS))
    found = pairs.where(match).groupBy(*by, key).agg(F.array_sort(F.collect_list(F.struct("ord", "ids"))).alias("_m"))
    return found.select(*by, key, F.array_distinct(F.flatten(F.transform("_m", lambda m: m["ids"]))).alias("origins"))
