"""Drawings as entities of two dialects: DXF, whose y goes up, and SVG, whose y goes down as on the sheet. One row an entity; files are written outside."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Layers of the roles, prefixes of the labels, height of the text, and where a label without a place goes.
LAYERS, PREFIXES, TEXT = {"hidden": "HIDDEN", "center": "CENTER"}, {"diameter": "Ø", "radius": "R"}, 14
BESIDE, CORNER, STEP = 10, 20, 30
#: Fixed values of dimension lines: gap from the geometry, how far extension lines go on, size and slimness of arrows, and how far over the line a text stands.
GAP, OVER, ARROW, SLIM, ABOVE, LEADER = 2.0, 9.0, 6.0, 0.32, 1.4, 10.0


def _text(pattern: str, *c: Column) -> Column:
    """The numbers in the pattern; null if one of them is."""
    return F.when(reduce(and_, [x.isNotNull() for x in c]), F.format_string(pattern, *[x.cast("double") for x in c]))


def dxf(p: DataFrame, height: Column) -> DataFrame:
    """p (type, role, x1, y1, x2, y2, cx, cy, r, a1, a2) with ``layer`` and ``entity``: struct<kind, x1, y1, x2, y2, r, start, stop>, y turned around at height.

    Angles grow downwards on the sheet and upwards here: they are negated and change places. An arc without both angles is a circle on a layer of its own;
    other types have no entity.
    """
    known, whole = F.col("type"), F.col("a1").isNotNull() & F.col("a2").isNotNull()
    layer = F.when(F.col("role") == "hidden", LAYERS["hidden"]).when(F.col("role") == "center", LAYERS["center"]).otherwise("VISIBLE")
    layer = F.when((known == "arc") & ~whole, "ARC").otherwise(layer)
    kind = F.when(known == "line", "LINE").when((known == "circle") | ((known == "arc") & ~whole), "CIRCLE").when(known == "arc", "ARC")
    line, arc = kind == "LINE", kind == "ARC"
    parts = {"x1": F.when(line, F.col("x1")).otherwise(F.col("cx")), "y1": height - F.when(line, F.col("y1")).otherwise(F.col("cy")), "x2": F.when(line, F.col("x2")), "y2": F.when(line, height - F.col("y2")), "r": F.when(~line, F.col("r")), "start": F.when(arc, -F.col("a2")), "stop": F.when(arc, -F.col("a1"))}
    entity = F.struct(kind.alias("kind"), *[c.cast("double").alias(k) for k, c in parts.items()])
    return p.withColumns({"layer": layer, "entity": F.when(kind.isNotNull(), entity)})


def labels(notes: DataFrame, p: DataFrame, by: str, height: Column) -> DataFrame:
    """(by, ord, label, x, y) of the annotations (by, ord, kind, value, text_x, text_y, refs): where they say, else beside the first of their references that is there, else in a column at the corner.

    Beside a circle or arc is right of it, beside a line its first end. p: by, id and geometry as for dxf(). Values have six digits at most.
    """
    at = F.when(F.col("type") == "line", F.struct(F.col("x1").cast("double").alias("x"), F.col("y1").cast("double").alias("y"))).otherwise(F.struct((F.col("cx") + F.coalesce("r", F.lit(0)) + BESIDE).cast("double").alias("x"), F.col("cy").cast("double").alias("y")))
    places = p.select(by, F.col("id").alias("_id"), at.alias("_at")).where("_at.x is not null")
    found = notes.select(by, "ord", F.posexplode("refs").alias("_pos", "_id")).join(places, [by, "_id"]).groupBy(by, "ord").agg(F.min_by("_at", "_pos").alias("_at"))
    n = notes.join(found, [by, "ord"], "left")
    own = F.when(F.col("text_x").isNotNull() & F.col("text_y").isNotNull(), F.struct(F.col("text_x").cast("double").alias("x"), F.col("text_y").cast("double").alias("y")))
    corner = F.struct(F.lit(float(CORNER)).alias("x"), (CORNER + F.col("ord") * STEP).cast("double").alias("y"))
    place = F.coalesce(own, F.col("_at"), corner)
    prefix = F.when(F.col("kind") == "diameter", PREFIXES["diameter"]).when(F.col("kind") == "radius", PREFIXES["radius"]).otherwise("")
    value = F.regexp_replace(F.format_string("%.6f", F.col("value").cast("double")), r"\.?0+$", "")
    return n.select(by, "ord", F.concat(prefix, value).alias("label"), place["x"].alias("x"), (height - place["y"]).alias("y"))


def svg_path() -> Column:
    """The path of a primitive in the row, as columns of dxf(): a circle is two half turns, an arc goes from a1 to a2 with growing angle, over more than half a turn by the large way."""
    kind = F.col("type")
    line = _text("M %.4f %.4f L %.4f %.4f", *[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    x, y, r = F.col("cx"), F.col("cy"), F.col("r")
    circle = _text("M %.4f %.4f A %.4f %.4f 0 1 0 %.4f %.4f A %.4f %.4f 0 1 0 %.4f %.4f Z", x - r, y, r, r, x + r, y, r, r, x - r, y)
    end = lambda a: (x + r * F.cos(F.radians(a)), y + r * F.sin(F.radians(a)))
    large = F.when(F.pmod(F.col("a2") - F.col("a1"), F.lit(360)) > 180, "1").otherwise("0")
    arc = F.concat(_text("M %.4f %.4f A %.4f %.4f 0 ", *end(F.col("a1")), r, r), large, F.lit(" 1 "), _text("%.4f %.4f", *end(F.col("a2"))))
    return F.when(kind == "line", line).when((kind == "arc") & arc.isNotNull(), arc).when(kind.isin("circle", "arc"), circle)


def svg_element(role: Column, path: Column) -> Column:
    return F.concat(F.lit('<path class="'), F.when(role == "hidden", "hidden").otherwise("visible"), F.lit('" d="'), path, F.lit('"/>'))


def _line(kind: str, *c: Column) -> Column:
    return F.concat(F.lit(f'<line class="{kind}" '), _text('x1="%.2f" y1="%.2f" x2="%.2f" y2="%.2f"/>', *c))


def _arrow(x: Column, y: Column, dx: float, dy: float) -> Column:
    """A tip at (x, y) that points along (dx, dy)."""
    wide = ARROW * SLIM
    bx, by = x - ARROW * dx, y - ARROW * dy
    return F.concat(_text('<polygon points="%.2f,%.2f %.2f,%.2f %.2f,%.2f"', x, y, bx - dy * wide, by + dx * wide, bx + dy * wide, by - dx * wide), F.lit(' fill="black"/>'))


def dimension(low: Column, high: Column, geometry: Column, at: Column, text: Column, across: bool) -> Column:
    """The elements of a linear dimension, one a line: two extension lines, the line with its arrows, and its text; across: along x, else along y.

    Extension lines begin a gap off the geometry and end behind the dimension's line, on whichever side that is.
    """
    a, b = F.least(low, high), F.greatest(low, high)
    side = F.when(at > geometry, 1.0).otherwise(-1.0)
    begin, end = geometry + side * GAP, at + side * OVER
    middle = (a + b) / 2
    flip = (lambda u, v: (u, v)) if across else (lambda u, v: (v, u))
    lines = [_line("ext", *flip(x, begin), *flip(x, end)) for x in (low, high)] + [_line("dim", *flip(a, at), *flip(b, at))]
    ways = ((-1.0, 0.0), (1.0, 0.0)) if across else ((0.0, -1.0), (0.0, 1.0))
    arrows = [_arrow(*flip(x, at), *w) for x, w in zip((a, b), ways, strict=True)]
    tx, ty = (middle, at - ABOVE) if across else (at - ABOVE, middle)
    turned = F.lit("") if across else _text(' transform="rotate(-90 %.2f %.2f)"', tx, ty)
    said = F.concat(_text('<text class="dimtxt" x="%.2f" y="%.2f" text-anchor="middle"', tx, ty), turned, F.lit(">"), text, F.lit("</text>"))
    return F.concat_ws("\n", *lines, *arrows, said)


def centre_cross(x: Column, y: Column, r: Column, over: float = 2.5) -> Column:
    n = r + over
    return F.concat_ws("\n", _line("center", x - n, y, x + n, y), _line("center", x, y - n, x, y + n))
