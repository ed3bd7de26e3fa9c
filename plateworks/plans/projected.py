"""Drawn against predicted primitives, curves of solids in three views, targets of heat maps, and counters of one pass.

On adapters of the given tables, as in plans.graphs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plateworks.operators import heat, matching, projection
from plateworks.plans.graphs import PRIMS, prims
from plateworks.plans.registry import query
from plateworks.shared import shared_dir, written
from plateworks.sources import table
from plateworks.sources.sinks import write_counted

_ON = "case when {q}.sq < 1e-6::double then sqrt(({x} - {q}.x1) ** 2 + ({y} - {q}.y1) ** 2) < 0.001::double else ({t}) >= -0.001::double and ({t}) <= 1.001::double and sqrt(({x} - ({q}.x1 + ({t}) * {q}.dx)) ** 2 + ({y} - ({q}.y1 + ({t}) * {q}.dy)) ** 2) < 0.001::double end"


def _on(x: str, y: str, q: str = "q") -> str:
    return _ON.format(x=x, y=y, q=q, t=f"(({x} - {q}.x1) * {q}.dx + ({y} - {q}.y1) * {q}.dy) / {q}.sq")


@query(PRIMS + f""", g as (select *, ['line', 'polyline', 'circle', 'arc', 'ellipse'][(pi % 5 + 1)::int] as type, x / 8.0::double as gx, y / 8.0::double as gy from p),
d as (select graph, view, pi, type, case when type in ('line', 'polyline') then [[gx, gy], [gx + len / 8.0::double, gy + face % 2 * len / 16.0::double]] || (case when type = 'polyline' then [[gx + len / 4.0::double, gy + face % 2 * len / 8.0::double]] else [] end) end as pts, gx, gy, r, len from g where role = 'hid'),
q as (select *, x2 - x1 as dx, y2 - y1 as dy, (x2 - x1) ** 2 + (y2 - y1) ** 2 as sq from (select graph, view, pi as ord, face, case type when 'polyline' then 'line' else type end as type, gx - len / 8.0::double as x1, gy - face % 2 * len / 16.0::double as y1, gx + len / 2.0::double as x2, gy + face % 2 * len / 4.0::double as y2, gx, gy, r, len from g where role = 'vis')),
m as (select d.graph, d.view, d.pi, q.ord, q.face from d join q using (graph, view) where case when d.type in ('line', 'polyline') then q.type = 'line' and list_bool_and(list_transform(d.pts, lambda z: {_on('z[1]', 'z[2]')}))
 when d.type = 'ellipse' then q.type = 'ellipse' and sqrt((d.gx - q.gx) ** 2 + (d.gy - q.gy) ** 2) < 0.001::double and d.len + d.r = q.len + q.r and d.r = q.r else q.type in ('circle', 'arc') and sqrt((d.gx - q.gx) ** 2 + (d.gy - q.gy) ** 2) < 0.001::double and d.r = q.r end)
select graph, view, pi, string_agg(face::varchar, ',' order by first) as origins from (select graph, view, pi, face, min(ord) as first from m group by all) group by all""")
def oracle_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hidden primitives of five types against visible ones as what the solid predicts: the faces of all that match, in order."""
    types = F.element_at(F.array(*map(F.lit, ("line", "polyline", "circle", "arc", "ellipse"))), (F.col("pi") % 5 + 1).cast("int"))
    g = written(prims(spark, sf_dir).withColumns({"type": types, "gx": F.col("x") / 8, "gy": F.col("y") / 8}), "prims")
    x, y, n, up = F.col("gx"), F.col("gy"), F.col("len"), F.col("face") % 2
    conic = {"cx": x, "cy": y, "r": F.col("r").cast("double"), "rmaj": (F.col("r") + n).cast("double"), "rmin": F.col("r").cast("double")}
    ends = F.array(F.array(x, y), F.array(x + n / 8, y + up * n / 16))
    pts = F.when(F.col("type") == "line", ends).when(F.col("type") == "polyline", F.array_append(ends, F.array(x + n / 4, y + up * n / 8)))
    drawn = g.where("role = 'hid'").select("graph", "view", "pi", "type", pts.alias("pts"), *[c.alias(k) for k, c in conic.items()])
    sort = F.when(F.col("type") == "polyline", "line").otherwise(F.col("type"))
    line = {"x1": x - n / 8, "y1": y - up * n / 16, "x2": x + n / 2, "y2": y + up * n / 4}
    predicted = g.where("role = 'vis'").select("graph", "view", F.col("pi").alias("ord"), F.array("face").alias("ids"), sort.alias("type"), *[c.alias(k) for k, c in (line | conic).items()])
    m = matching.origins(drawn, predicted, ["graph", "view"], "pi")
    return m.select("graph", "view", "pi", F.array_join(F.transform("origins", lambda f: f.cast("string")), ",").alias("origins"))


_SHOWN = {"front": ("-z{0}", "x{0}"), "top": ("x{0}", "y{0}"), "right": ("z{0}", "-y{0}")}
_WAY = {"front": (0, -1, 0), "top": (0, 0, 1), "right": (1, 0, 0)}


def _curves_sql() -> str:
    """The same hy halves and cross products written out; angles are told hy the covariance of both half diameters instead of the turn that is largest."""
    views = []
    for view, (u, v) in _SHOWN.items():
        w = _WAY[view]
        cross = (f"(ay * {w[2]} - az * {w[1]})", f"(az * {w[0]} - ax * {w[2]})", f"(ax * {w[1]} - ay * {w[0]})")
        views.append(f"select *, '{view}' as view, (ax * {w[0]} + ay * {w[1]} + az * {w[2]}) as along, {cross[0]} as hx, {cross[1]} as hy, {cross[2]} as hz, {u.format(0)} as cu, {v.format(0)} as cv, {u.format(1)} as pu, {v.format(1)} as pv, {u.format(2)} as qu, {v.format(2)} as qv from n")
    at = lambda c: "case view when 'front' then {0} when 'top' then {1} else {2} end".format(*[s[c] for s in _SHOWN.values()])
    one = (at(0).replace("{0}", "f"), at(1).replace("{0}", "f"))
    two = (at(0).replace("{0}", "g"), at(1).replace("{0}", "g"))
    return f"""with c as (select p_partkey as k, ['line', 'circle', 'ellipse', 'spline'][(p_partkey % 4 + 1)::int] as curve, (p_partkey % 17)::double as x0, (p_size % 5)::double as y0, (p_partkey // 4 % 7)::double as z0,
 (p_partkey // 4 % 3)::double as mx, (p_size % 3)::double as my, (p_partkey // 12 % 2)::double as mz, (1 + p_size % 9)::double as r from part),
n as (select k, curve, x0, y0, z0, x0 as x1, y0 as y1, z0 as z1, x0 + mx as x2, y0 + my as y2, z0 + mz as z2, r, sqrt(mx * mx + my * my + mz * mz) as m, mx / nullif(sqrt(mx * mx + my * my + mz * mz), 0) as ax, my / nullif(sqrt(mx * mx + my * my + mz * mz), 0) as ay, mz / nullif(sqrt(mx * mx + my * my + mz * mz), 0) as az from c),
v as ({' union all '.join(views)}),
s as (select *, sqrt(hx * hx + hy * hy + hz * hz) as bn from v),
h as (select *, case when curve = 'circle' then r * hx / nullif(bn, 0) else r * 2 * ax end as xf, case when curve = 'circle' then r * hy / nullif(bn, 0) else r * 2 * ay end as yf, case when curve = 'circle' then r * hz / nullif(bn, 0) else r * 2 * az end as zf,
 case when curve = 'circle' then r * (ay * hz - az * hy) / nullif(bn, 0) else r * ey end as xg, case when curve = 'circle' then r * (az * hx - ax * hz) / nullif(bn, 0) else r * ex end as yg, case when curve = 'circle' then r * (ax * hy - ay * hx) / nullif(bn, 0) else 0 end as zg
 from (select *, case when ax * ax + ay * ay < 1e-12::double then 0 else -ay / sqrt(ax * ax + ay * ay) end as ey, case when ax * ax + ay * ay < 1e-12::double then 1 else ax / sqrt(ax * ax + ay * ay) end as ex from s)),
e as (select *, {one[0].replace('xf', 'xf')} as fu, {one[1]} as fv, {two[0]} as gu, {two[1]} as gv from h),
a as (select *, fu * fu + gu * gu as suu, fv * fv + gv * gv as svv, fu * fv + gu * gv as suv from e),
w as (select *, sqrt(greatest(((suu + svv) + sqrt((suu - svv) ** 2 + 4 * suv * suv)) / 2, 0)) as rj, sqrt(greatest(((suu + svv) - sqrt((suu - svv) ** 2 + 4 * suv * suv)) / 2, 0)) as rn from a),
k as (select *, case when curve = 'spline' then 'unsupported' when m = 0 and curve <> 'line' then 'unreadable' when curve = 'line' and round(pu, 3) = round(qu, 3) and round(pv, 3) = round(qv, 3) then 'point' end as skipped,
 case curve when 'line' then 'line' when 'circle' then case when abs(along) < 1e-6 then 'line' when abs(abs(along) - 1) < 1e-6 then 'circle' else 'ellipse' end else 'ellipse' end as type from w)
select k as part, view, case when skipped is null then type end as type, skipped, case when skipped is null then round(case when type = 'line' then least(lu1, lu2) else cu end, 3) + 0.0 end as u,
 case when skipped is null then round(case when type = 'line' then sqrt((lu1 - lu2) ** 2 + (lv1 - lv2) ** 2) end, 3) + 0.0 end as length,
 case when skipped is null and type = 'ellipse' then round(rj, 3) + 0.0 when skipped is null and type = 'circle' then r end as major, case when skipped is null and type = 'ellipse' then round(rn, 3) + 0.0 end as minor from (select *, round(case when curve = 'line' then pu else cu + fu end, 3) as lu1, round(case when curve = 'line' then qu else cu - fu end, 3) as lu2, round(case when curve = 'line' then pv else cv + fv end, 3) as lv1, round(case when curve = 'line' then qv else cv - fv end, 3) as lv2 from k) k"""


@query(_curves_sql())
def projected_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, circles and ellipses in space as three views show them; a curve of another kind, or without a direction, is skipped with its reason."""
    k, s = F.col("p_partkey"), F.col("p_size")
    p = table(spark, sf_dir, "part").select(
        k.alias("part"), F.element_at(F.array(*map(F.lit, ("line", "circle", "ellipse", "spline"))), (k % 4 + 1).cast("int")).alias("curve"), projection.vector(k % 17, s % 5, F.expr("p_partkey div 4 % 7")).alias("centre"),
        projection.vector(F.expr("p_partkey div 4 % 3"), s % 3, F.expr("p_partkey div 12 % 2")).alias("way"), (1 + s % 9).cast("double").alias("r"),
    )
    # An ellipse's axis is at right angles to its major one, and lies so that its minor one is level.
    way = F.col("way")
    level = F.when(way["x"] * way["x"] + way["y"] * way["y"] < 1e-12, projection.vector(F.lit(0), F.lit(1), F.lit(0))).otherwise(projection.vector(-way["y"], way["x"], F.lit(0)))
    axis = F.when(F.col("curve") == "ellipse", projection.cross(way, level)).otherwise(way)
    c = p.withColumns({"p1": F.col("centre"), "p2": projection.plus(F.col("centre"), way), "axis": axis, "major": way, "rmaj": F.col("r") * 2, "rmin": F.col("r")})
    d = projection.project(c)
    sh = lambda n: F.col(f"shape.{n}")
    three = lambda v: F.round(v, 3) + 0.0
    line = sh("type") == "line"
    length = F.hypot(sh("u1") - sh("u2"), sh("v1") - sh("v2"))
    return d.select("part", "view", sh("type").alias("type"), "skipped", three(F.when(line, F.least(sh("u1"), sh("u2"))).otherwise(sh("u1"))).alias("u"), three(F.when(line, length)).alias("length"), three(F.coalesce(sh("rmaj"), sh("r"))).alias("major"), three(sh("rmin")).alias("minor"))


@query(PRIMS + """, c as (select graph, view, x * 3 / 4.0::double as gx, y * 5 + 0.25::double as gy, r / 2.0::double as s, r from p where role = 'vis'),
w as (select graph, view, unnest(range(greatest(0, ceil(gy - 3 * greatest(1, s * 0.3::double)))::bigint, least(15, floor(gy + 3 * greatest(1, s * 0.3::double)))::bigint + 1)) as iy, gx, gy, greatest(1, s * 0.3::double) as sg from c),
v as (select *, unnest(range(greatest(0, ceil(gx - 3 * sg))::bigint, least(39, floor(gx + 3 * sg))::bigint + 1)) as ix from w),
h as (select graph, view, iy, ix, max(exp(-((iy - gy) ** 2 + (ix - gx) ** 2) / (2 * sg * sg))) as heat from v group by all),
m as (select graph, view, round_even(gy, 0)::bigint as cy, round_even(gx, 0)::bigint as cx, max(r) as r from c where gx < 40 and gy < 16 group by all),
k as (select graph, view, least(cy, 15) as cy, least(cx, 39) as cx, max(r) as r from m group by all),
n as (select graph, view, cy + dy as iy, cx + dx as ix, max(ln(greatest(r, 1))) as radius, bool_or(dy = 0 and dx = 0) as centre from k, (select unnest([-1, 0, 1]) as dy), (select unnest([-1, 0, 1]) as dx) where cy + dy between 0 and 15 and cx + dx between 0 and 39 group by all)
select graph, view, count(*) as n_cells, count(*) filter (centre) as n_centres, count(radius) as n_beside, sum(round(case when centre then 1 else coalesce(heat, 0) end * 1000000)::bigint)::bigint as heat, max(radius) as radius,
 sum((iy * 40 + ix) * round(case when centre then 1 else coalesce(heat, 0) end * 1000)::bigint)::bigint as moment from h full join n using (graph, view, iy, ix) group by all""")
def heat_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training targets of a detector, the heat around each circle's centre and its radius as a logarithm in the cells beside it, summed up for each map."""
    p = prims(spark, sf_dir).where("role = 'vis'")
    c = p.select("graph", "view", (F.col("x") * 3).cast("double").alias("x"), (F.col("y") * 20 + 1).cast("double").alias("y"), (F.col("r") * 2).cast("double").alias("r"))
    t = heat.targets(c, ["graph", "view"], width=40, height=16, stride=4, code=lambda r: F.ln(F.greatest(r / 2, F.lit(1.0))))
    whole = lambda scale: F.round(F.col("heat") * scale).cast("long")
    moment = F.sum((F.col("iy") * 40 + F.col("ix")) * whole(1000))
    return t.groupBy("graph", "view").agg(F.count("*").alias("n_cells"), F.count_if("centre").alias("n_centres"), F.count("radius").alias("n_beside"), F.sum(whole(1_000_000)).alias("heat"), F.max("radius").alias("radius"), moment.alias("moment"))


@query("""with d as (select doc_id, n_chars, coalesce(len(text), 0) as n from documents), t as (select count(*) filter (n > 20000) as n_over, count(*) filter (n < 40) as n_short, count(*) filter (n <> n_chars) as n_other from d)
select doc_id, n_chars, n_over, n_short, n_other from d, t where n <= 20000""")
def length_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of at most 20,000 characters, written, with what the pass that wrote them counted: those too long, those short, those whose length is said wrongly."""
    n = F.char_length(F.coalesce("text", F.lit("")))
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", n.alias("n"))
    path = f"{shared_dir(spark)}/plateworks-kept-{spark.sparkContext.applicationId}-{id(d)}"
    told = write_counted(d, path, {"n_over": F.col("n") > 20_000, "n_short": F.col("n") < 40, "n_other": F.col("n") != F.col("n_chars")}, keep=F.col("n") <= 20_000)
    counts = [F.lit(told.get(k, 0)).cast("long").alias(k) for k in ("n_over", "n_short", "n_other")]
    return spark.read.parquet(path).select("doc_id", "n_chars", *counts)
