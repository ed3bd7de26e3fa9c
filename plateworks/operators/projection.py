"""Curves in space as a view shows them: vectors are struct<x, y, z>, points of the sheet struct<u, v>."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMALL, PLACES = 1e-6, 3
#: Direction of each view and its axes on the sheet, each an axis of space and a sign.
VIEWS = {"front": ((0, -1, 0), (("z", -1), ("x", 1))), "top": ((0, 0, 1), (("x", 1), ("y", 1))), "right": ((1, 0, 0), (("z", 1), ("y", -1)))}


def vector(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"))


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross(a: Column, b: Column) -> Column:
    return vector(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


def plus(a: Column, b: Column, times: Column | float = 1.0) -> Column:
    return vector(*[a[c] + b[c] * times for c in "xyz"])


def unit(a: Column) -> Column:
    """a at length 1; null if it has none."""
    n = F.sqrt(dot(a, a))
    return F.when(n > 1e-12, vector(*[a[c] / n for c in "xyz"]))


def axes(f1: tuple[str, str], f2: tuple[str, str]) -> dict[str, Column]:
    """rmaj, rmin and rot of the ellipse with these conjugate half diameters (columns); rot of the major axis in [0, 180) degrees.

    Half diameters go round the ellipse; the turn at which one is longest makes them its axes.
    """
    (ax, ay), (bx, by) = (tuple(F.col(c) for c in f) for f in (f1, f2))
    t = F.atan2(2 * (ax * bx + ay * by), ax * ax + ay * ay - bx * bx - by * by) / 2
    # Of the struct each part is worked out once.
    turn = F.struct(F.cos(t).alias("c"), F.sin(t).alias("s"))
    both = lambda k: F.struct((k["c"] * ax + k["s"] * bx).alias("x"), (k["c"] * ay + k["s"] * by).alias("y"), (k["c"] * bx - k["s"] * ax).alias("z"), (k["c"] * by - k["s"] * ay).alias("w"))
    k = F.transform(F.array(F.transform(F.array(turn), both)[0]), lambda v: F.struct(F.hypot(v["x"], v["y"]).alias("a"), F.hypot(v["z"], v["w"]).alias("b"), F.atan2(v["y"], v["x"]).alias("ta"), F.atan2(v["w"], v["z"]).alias("tb")))[0]
    return {"rmaj": F.greatest(k["a"], k["b"]), "rmin": F.least(k["a"], k["b"]), "rot": F.pmod(F.degrees(F.when(k["a"] >= k["b"], k["ta"]).otherwise(k["tb"])), F.lit(180.0))}


def _rounded(c: Column) -> Column:
    return F.round(c, PLACES) + 0.0


def _views() -> Column:
    """Each view with its direction and the axes of its sheet as vectors."""
    whole = lambda v: vector(*[F.lit(float(x)) for x in v])
    axis = lambda a, sign: whole([sign * (c == a) for c in "xyz"])
    return F.explode(F.array(*[F.struct(F.lit(n).alias("view"), whole(way).alias("way"), axis(*u).alias("u"), axis(*v).alias("v")) for n, (way, (u, v)) in VIEWS.items()]))


def project(curves: DataFrame) -> DataFrame:
    """curves once for each view, with ``view``, ``shape`` (struct<type, u1, v1, u2, v2, r, rmaj, rmin, rot>, rounded) and ``skipped``.

    curves: curve (line, circle, ellipse), p1, p2, centre, axis, major (vectors), r, rmaj, rmin. A circle seen from the side is a line, seen along
    its axis a circle, else an ellipse. skipped says why there is no shape: unsupported (another kind, or none), unreadable (what it
    needs is null or has no length) or point (a line seen along itself).
    """
    col, kind = F.col, F.col("curve")
    d = curves.withColumn("_v", _views()).withColumns({"_axis": unit(col("axis")), "_major": unit(col("major"))})
    # Two half diameters at right angles: of a circle one across the view's direction, of an ellipse its own.
    d = d.withColumns({"_along": dot(col("_axis"), col("_v.way")), "_one": F.when(kind == "circle", unit(cross(col("_axis"), col("_v.way")))).when(kind == "ellipse", col("_major"))})
    d = d.withColumn("_two", F.when(kind == "circle", cross(col("_axis"), col("_one"))).when(kind == "ellipse", unit(cross(col("_axis"), col("_major")))))
    flat = {}
    for name, p in {"c": "centre", "p": "p1", "q": "p2"}.items():
        flat |= {f"_{name}{k}": dot(col(p), col(f"_v.{k}")) for k in "uv"}
    longest, least = F.when(kind == "circle", col("r")).otherwise(col("rmaj")), F.when(kind == "circle", col("r")).otherwise(col("rmin"))
    flat |= {f"_f{k}": dot(col("_one"), col(f"_v.{k}")) * longest for k in "uv"} | {f"_g{k}": dot(col("_two"), col(f"_v.{k}")) * least for k in "uv"}
    d = d.withColumns(flat)
    edge, face = F.abs("_along") < SMALL, F.abs(F.abs("_along") - 1) < SMALL
    shape = F.when(kind == "line", "line").when(kind == "ellipse", "ellipse").when(edge, "line").when(face, "circle").otherwise("ellipse")
    d = d.withColumns({"_type": shape, "_ax": F.struct(*[v.alias(k) for k, v in axes(("_fu", "_fv"), ("_gu", "_gv")).items()])})
    is_ = lambda *t: col("_type").isin(*t)
    end = lambda k, first: F.when(kind == "line", col(f"_p{k}" if first else f"_q{k}")).when(is_("line"), col(f"_c{k}") + (1 if first else -1) * col(f"_f{k}"))
    parts = {"u1": F.coalesce(end("u", True), col("_cu")), "v1": F.coalesce(end("v", True), col("_cv")), "u2": end("u", False), "v2": end("v", False), "r": F.when(is_("circle"), col("r"))}
    parts |= {k: F.when(is_("ellipse"), col(f"_ax.{k}")) for k in ("rmaj", "rmin", "rot")}
    d = d.withColumn("_shape", F.struct(col("_type").alias("type"), *[_rounded(c).alias(k) for k, c in parts.items()]))
    lacks = lambda *names: reduce(or_, [col(n).isNull() for n in names])
    broken = F.when(kind == "line", lacks("p1", "p2")).when(kind == "circle", lacks("_axis", "centre", "r")).when(kind == "ellipse", lacks("_major", "_two", "centre", "rmaj", "rmin"))
    point = (kind == "line") & (col("_shape.u1") == col("_shape.u2")) & (col("_shape.v1") == col("_shape.v2"))
    why = F.when(kind.isNull() | ~kind.isin("line", "circle", "ellipse"), "unsupported").when(broken, "unreadable").when(point, "point")
    d = d.withColumn("skipped", why)
    return d.select(*curves.columns, col("_v.view").alias("view"), F.when(col("skipped").isNull(), col("_shape")).alias("shape"), "skipped")
