"""Geometry queries over parts, orders, line items and embeddings. The geometry is synthetic; only the operators are meant."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plateworks.operators import clouds, rules
from plateworks.operators import geometry as g
from plateworks.plans.registry import query
from plateworks.shared import written
from plateworks.sources import table

_POINTS = "with p as (select p_partkey as id, p_size::double as x, (p_partkey % 37)::double as y, (p_partkey % 11)::double as z, p_retailprice as v from part)\n"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    return p.select(key.alias("id"), F.col("p_size").cast("double").alias("x"), (key % 37).cast("double").alias("y"), (key % 11).cast("double").alias("z"), F.col("p_retailprice").alias("v"))


@query(_POINTS + "select id, round(1 * (x - 12.5) / 4.0, 6) as u, round(-1 * (y - 7.25) / 4.0, 6) as v from p")
def part_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels to the part's frame; the second axis is flipped."""
    p = points(spark, sf_dir)
    return p.select("id", F.round(g.to_part_frame(F.col("x"), 12.5, 1, 4.0), 6).alias("u"), F.round(g.to_part_frame(F.col("y"), 7.25, -1, 4.0), 6).alias("v"))


def _affine_sql(sign: int) -> str:
    c, s = f"cos(radians({sign} * 3.0))", f"sin(radians({sign} * 3.0))"
    return f"round(1.02 * ((x - 25.0) * {c} - (y - 18.0) * {s}) + 25.0 + 4.0, 6) as sx, round(1.02 * ((x - 25.0) * {s} + (y - 18.0) * {c}) + 18.0 - 3.0, 6) as sy"


@query(_POINTS + f"select id, 'generator' as kind, {_affine_sql(-1)} from p union all select id, 'scorer' as kind, {_affine_sql(1)} from p")
def affine_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean to scanned coordinates with either sign of the rotation."""
    p = points(spark, sf_dir)
    out = []
    for kind, sign in (("generator", -1), ("scorer", 1)):
        sx, sy = g.affine(F.col("x"), F.col("y"), 3.0, 1.02, 4.0, -3.0, 25.0, 18.0, sign)
        out.append(p.select("id", F.lit(kind).alias("kind"), F.round(sx, 6).alias("sx"), F.round(sy, 6).alias("sy")))
    return out[0].unionByName(out[1])


_T = lambda e: f"(({e}) - 360 * floor(({e}) / 360))"


@query(_POINTS + f""", a as (select id, x * 17 - 400 as s, y * 31 - 500 as m, z * 41 - 100 as e from p),
b as (select id, s, e, {_T('m - s')} <= {_T('e - s')} as straight from a)
select id, case when straight then {_T('s')} else {_T('e')} end as start_angle, case when straight then {_T('e')} else {_T('s')} end as end_angle from b""")
def arc_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, m, e = F.col("x") * 17 - 400, F.col("y") * 31 - 500, F.col("z") * 41 - 100
    a, b = g.swept_angles(s, m, e)
    return points(spark, sf_dir).select("id", a.alias("start_angle"), b.alias("end_angle"))


@query(_POINTS + ", e as (select max(greatest(abs(x), abs(y))) as ext from p) select id, round_even(x / (ext / 255), 0)::bigint as qx, round_even(y / (ext / 255), 0)::bigint as qy from p, e")
def quantise_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates on one grid of 256 for both axes."""
    p = points(spark, sf_dir)
    ext = p.agg(F.max(F.greatest(F.abs("x"), F.abs("y"))).alias("ext"))
    q = lambda c: g.quantized(F.col(c), F.col("ext"), 256)
    return p.join(F.broadcast(ext)).select("id", q("x").alias("qx"), q("y").alias("qy"))


@query(_POINTS + """, t as (select id, x as ux, y as uy, z as vx, x - y as vy from p), a as (select *, atan2(2 * (ux * vx + uy * vy), ux * ux + uy * uy - vx * vx - vy * vy) / 2 as t from t),
b as (select id, ux * cos(t) + vx * sin(t) as ax, uy * cos(t) + vy * sin(t) as ay, -ux * sin(t) + vx * cos(t) as bx, -uy * sin(t) + vy * cos(t) as byy from a)
select id, round(sqrt(ax * ax + ay * ay), 5) as rmaj, round(sqrt(bx * bx + byy * byy), 5) as rmin from b""")
def ellipse_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Principal radii from two conjugate ones."""
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    major, minor, _ = g.principal_axes(x, y, z, x - y)
    return points(spark, sf_dir).select("id", F.round(major, 5).alias("rmaj"), F.round(minor, 5).alias("rmin"))


@query(_POINTS + "select id, v.view, case when v.view in ('front', 'top') then x when v.view = 'right' then y end as u, case when v.view in ('front', 'right') then z when v.view = 'top' then y end as w from p, (select unnest(['front', 'top', 'right', 'iso']) as view) v")
def project_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).withColumn("view", F.explode(F.array(*[F.lit(v) for v in ("front", "top", "right", "iso")])))
    u, w = g.projected(F.col("view"), F.col("x"), F.col("y"), F.col("z"))
    return p.select("id", "view", u.alias("u"), w.alias("w"))


@query(_POINTS + "select id, round((x * 2.0 + 40.0) * 3.78, 2) as px, round((297.0 - (y * 2.0 + 25.0)) * 3.78, 2) as py from p")
def layout_affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical coordinates to sheet millimetres to pixels, y downward."""
    return points(spark, sf_dir).select("id", F.round((F.col("x") * 2.0 + 40.0) * 3.78, 2).alias("px"), F.round((297.0 - (F.col("y") * 2.0 + 25.0)) * 3.78, 2).alias("py"))


_ENV = "sqrt(x * x + y * y + z * z)"


@query(_POINTS + f"select id, {_ENV} > 0 and abs(v - 1000) <= 1.5 * {_ENV} + greatest(1.0, 0.1 * {_ENV}) as is_inside, case when y / greatest(x, 1.0) > 10 and y > 2 * {_ENV} or y > 5 * {_ENV} then true else false end as ill from p")
def envelope_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a point stays in the widened envelope and a partial conic is ill-conditioned."""
    x, y, z, v = (F.col(c) for c in "xyzv")
    d = F.sqrt(x * x + y * y + z * z)
    ill = ((y / F.greatest(x, F.lit(1.0)) > 10) & (y > 2 * d)) | (y > 5 * d)
    return points(spark, sf_dir).select("id", ((d > 0) & (F.abs(v - 1000) <= 1.5 * d + F.greatest(F.lit(1.0), F.lit(0.1) * d))).alias("is_inside"), ill.alias("ill"))


@query("""with o as (select o_orderkey, unnest(['x', 'y']) as axis, unnest([round_even(o_totalprice / 100, 0)::bigint, (o_custkey % 37) * 90 + 200]) as e from orders), n as (select *, ceil((e - 1024) / 840.0)::bigint + 1 as n from o),
s as (select o_orderkey, axis, e, case when e <= 1024 then [0] else list_transform(range(n), lambda i: least(round_even(i * (e - 1024) / (n - 1), 0)::bigint, e - 1024)) end as st from n),
g as (select x.o_orderkey, x.e as w, y.e as h, unnest(range(len(x.st) * len(y.st))) as i, x.st as xs, y.st as ys from s x join s y on x.o_orderkey = y.o_orderkey and x.axis = 'x' and y.axis = 'y'),
t as (select o_orderkey, i, xs[(i % len(xs) + 1)::int] as x0, ys[(i // len(xs) + 1)::int] as y0, w, h from g)
select o_orderkey, count(*) as n_tiles, max(least(x0 + 1024, w)) as x_end, max(least(y0 + 1024, h)) as y_end, sum(i * (x0 + 3 * y0))::bigint as weight, sum((least(x0 + 1024, w) - x0) * (least(y0 + 1024, h) - y0))::bigint as area from t group by o_orderkey""")
def tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of 1024 by 1024 with an overlap of 0.18 over sheets of many sizes, numbered row by row: how many, where they end, and sums that tell each one's number and box."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.rint(F.col("o_totalprice") / 100).cast("long").alias("w"), (F.col("o_custkey") % 37 * 90 + 200).alias("h"))
    t = o.select("o_orderkey", F.explode(g.tiles(F.col("w"), F.col("h"), 1024, 0.18)).alias("t")).select("o_orderkey", "t.*")
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return t.groupBy("o_orderkey").agg(F.count("*").alias("n_tiles"), F.max("x1").alias("x_end"), F.max("y1").alias("y_end"), F.sum(F.col("i") * (F.col("x0") + 3 * F.col("y0"))).alias("weight"), F.sum(area).alias("area"))


@query(_POINTS + "select id, coalesce((select max(s) from (select unnest([10.0, 5.0, 4.0, 2.5, 2.0, 1.0, 0.5, 0.4, 0.25, 0.2, 0.1, 0.05]) as s) q where p.x * 8 * s <= 360 and p.y * 8 * s <= 250), 0.05)::double as scale from p")
def sheet_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("id", g.sheet_scale(F.col("x") * 8, F.col("y") * 8, 360, 250).alias("scale"))


_CLOUD = "with c as (select vec_id, label, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z from embeddings)\n"


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of clouds: the first three numbers of an embedding, by label."""
    at = lambda i: F.col("embedding")[i].cast("double")
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))


@query(_CLOUD + """, b as (select label, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1, min(z) as z0, max(z) as z1 from c group by label)
select vec_id, round((x - (x0 + x1) / 2) / greatest(x1 - x0, y1 - y0, z1 - z0), 6) as ux, round((y - (y0 + y1) / 2) / greatest(x1 - x0, y1 - y0, z1 - z0), 6) as uy, round(z - z0, 6) as az from c join b using (label)""")
def unit_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clouds centred in a unit box, and moved so that they begin at 0. The boxes are few rows, made before the join."""
    c = cloud(spark, sf_dir)
    b = c.groupBy("label").agg(*[f(a).alias(f"{a}{i}") for a in "xyz" for i, f in enumerate((F.min, F.max))])
    side = F.greatest(*[F.col(f"{a}1") - F.col(f"{a}0") for a in "xyz"])
    unit = lambda a: F.round((F.col(a) - (F.col(f"{a}0") + F.col(f"{a}1")) / 2) / side, 6)
    return c.join(b, "label").select("vec_id", unit("x").alias("ux"), unit("y").alias("uy"), F.round(F.col("z") - F.col("z0"), 6).alias("az"))


@query(_CLOUD + """, d as (select a.label, a.vec_id, min((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) as d from c a join c b on b.label = (a.label + 1) % 10 group by all),
e as (select a.label, b.vec_id, min((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) as d from c a join c b on b.label = (a.label + 1) % 10 group by all),
f as (select label, count(*) as n, avg(d) as there from d group by label), h as (select label, avg(d) as back from e group by label)
select label, n, round(there, 5) as mean_sq, round(back, 5) as mean_sq_back, round(there + back, 5) as chamfer from f join h using (label)""")
def chamfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean squared distance of a cloud's points to the next cloud, of that one's points to this one, and the sum."""
    c = written(cloud(spark, sf_dir), "cloud")
    label, after = F.col("label"), (F.col("label") + 1) % 10
    pairs = c.where("label is not null").select("label").distinct()
    there = pairs.select(F.col("label").alias("pair"), F.lit(True).alias("there"), label.alias("from"), after.alias("to"))
    back = pairs.select(F.col("label").alias("pair"), F.lit(False).alias("there"), after.alias("from"), label.alias("to"))
    asked = c.withColumnRenamed("label", "from").join(there.unionByName(back), "from")
    d = clouds.nearest_sq(asked, c.withColumnRenamed("label", "to"), "to")
    # Rows of one vec_id count once, with the least distance.
    d = d.groupBy("pair", "there", "vec_id").agg(F.min("sq").alias("d")).groupBy("pair", "there").agg(F.count("*").alias("n"), F.avg("d").alias("mean"))
    of = lambda way, c: F.max(F.when(F.col("there") == way, F.col(c)))
    both = d.groupBy(F.col("pair").alias("label")).agg(of(True, "n").alias("n"), of(True, "mean").alias("one"), of(False, "mean").alias("two"), F.count("*").alias("ways")).where("ways = 2")
    one, two = F.col("one"), F.col("two")
    return both.select("label", "n", F.round(one, 5).alias("mean_sq"), F.round(two, 5).alias("mean_sq_back"), F.round(one + two, 5).alias("chamfer"))


@query(_POINTS + "select id, case when z = 0 then 'polyline' when z < 4 then 'line' when z < 8 then 'circle' else 'ellipse' end as kind, case when z = 0 then 'fallback' when x > 45 then 'rejected' else 'ok' end as status from p")
def projector_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of curves and what became of them: fallbacks and rejections are counted, not fatal."""
    z, x = F.col("z"), F.col("x")
    kind = rules.first_of({"polyline": z == 0, "line": z < 4, "circle": z < 8}, "ellipse")
    return points(spark, sf_dir).select("id", kind.alias("kind"), rules.first_of({"fallback": z == 0, "rejected": x > 45}, "ok").alias("status"))


@query("select l_orderkey, l_linenumber, l_partkey, count(*) as n, round(sum(sqrt(power(l_quantity - 25, 2) + power(l_tax * 100 - 4, 2))), 4) as d from lineitem group by all having count(*) > 0")
def point_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, t = F.col("l_quantity") - 25, F.col("l_tax") * 100 - 4
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.count("*").alias("n"), F.round(F.sum(F.sqrt(q * q + t * t)), 4).alias("d"))


