"""Queries on drawings as tables of primitives.

The given tables hold no drawings. Line items stand for primitives: the part is the drawing, the return flag the view, the line status the role,
quantity, discount and tax the geometry, and the supplier the face. The geometry is synthetic; only the operators are meant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plateworks.operators import drawing, graph, rules, selection, stats
from plateworks.plans.registry import query
from plateworks.shared import written
from plateworks.sources import table

_ALL = ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def prims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """graph, view, role, pi (emission ordinal), x, y, len, r, face."""
    # Numbered under the name that the rows keep, so that what is worked out by drawing afterwards finds them in place.
    order = Window.partitionBy("graph").orderBy(*_ALL)
    return table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "graph").select(
        "graph",
        F.col("l_returnflag").alias("view"),
        F.when(F.col("l_linestatus") == "F", "vis").otherwise("hid").alias("role"),
        F.row_number().over(order).cast("long").alias("pi"),
        F.col("l_quantity").cast("long").alias("x"),
        (F.col("l_linenumber") % 2).cast("long").alias("y"),
        (F.round(F.col("l_discount") * 100).cast("long") + 1).alias("len"),
        (F.round(F.col("l_tax") * 100).cast("long") + 1).alias("r"),
        (F.col("l_suppkey") % 20).cast("long").alias("face"),
    )


PRIMS = f"""with p as (select l_partkey as graph, l_returnflag as view, case when l_linestatus = 'F' then 'vis' else 'hid' end as role,
 row_number() over (partition by l_partkey order by {', '.join(_ALL)})::bigint as pi, l_quantity::bigint as x, (l_linenumber % 2)::bigint as y,
 (round(l_discount * 100)::bigint + 1) as len, (round(l_tax * 100)::bigint + 1) as r, (l_suppkey % 20)::bigint as face from lineitem)
"""


@query(PRIMS + """, ff as (select distinct (s_suppkey % 20)::bigint as face, 'cyl' || (s_nationkey % 6) as feature from supplier),
j as (select graph, pi, feature from p join ff using (face))
select graph, count(distinct pi) as n_tagged, string_agg(distinct feature, ',' order by feature) as tags from j group by graph""")
def face_join_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of each drawing by the faces that its primitives share."""
    faces = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 20).cast("long").alias("face"), F.concat(F.lit("cyl"), (F.col("s_nationkey") % 6).cast("string")).alias("feature")).distinct()
    j = prims(spark, sf_dir).join(faces, "face")
    return j.groupBy("graph").agg(F.count_distinct("pi").alias("n_tagged"), F.array_join(F.sort_array(F.collect_set("feature")), ",").alias("tags"))


@query(PRIMS + "select graph, view, role, x, y, len, min(pi) as first_pi, string_agg(pi::varchar, ',' order by pi) as ids, array_to_string(list_distinct_ordered, ',') as faces from (select *, list(face) over (partition by graph, view, role, x, y, len order by pi rows between unbounded preceding and unbounded following) as fs from p) q, lateral (select list_filter(fs, lambda f, i: list_position(fs, f) = i) as list_distinct_ordered) group by graph, view, role, x, y, len, list_distinct_ordered")
def dup_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates: the first wins, ids and faces are appended in order."""
    p = prims(spark, sf_dir).withColumn("id", F.col("pi"))
    m = drawing.merged(p, ["graph", "view", "role", "x", "y", "len"], "pi", "id", "face")
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",")
    return m.select("graph", "view", "role", "x", "y", "len", "first_pi", text("id").alias("ids"), text("face").alias("faces"))


@query(PRIMS + "select graph, view, pi, row_number() over (partition by graph order by case view when 'N' then 0 when 'R' then 1 else 9 end, view, case role when 'vis' then 0 else 1 end, x, y, r, pi) as place from p")
def canonical_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order of views (known ones first), roles, first point, radius; ties by emission."""
    view = F.when(F.col("view") == "N", 0).when(F.col("view") == "R", 1).otherwise(9)
    role = F.when(F.col("role") == "vis", 0).otherwise(1)
    return selection.numbered(prims(spark, sf_dir), ["graph"], [view, "view", role, "x", "y", "r", "pi"], "place").select("graph", "view", "pi", "place")


@query("select p_brand as graph, p_partkey as feature, 'C' || row_number() over (partition by p_brand order by coalesce(p_type, ''), -p_size, p_retailprice, p_partkey) as number from part")
def feature_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    n = selection.numbered(p, ["p_brand"], [F.coalesce("p_type", F.lit("")), -F.col("p_size"), "p_retailprice", "p_partkey"])
    return n.select(F.col("p_brand").alias("graph"), F.col("p_partkey").alias("feature"), F.concat(F.lit("C"), F.col("n").cast("string")).alias("number"))


@query("""select 'customer' as rule, o_orderkey as id from orders where o_custkey not in (select c_custkey from customer where c_acctbal > 0)
union all select 'order' as rule, l_orderkey as id from (select distinct l_orderkey from lineitem) where l_orderkey not in (select o_orderkey from orders where o_orderstatus <> 'P')""")
def ref_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that don't resolve, by rule."""
    o = table(spark, sf_dir, "orders")
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 0")
    a = o.join(rich, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select(F.lit("customer").alias("rule"), F.col("o_orderkey").alias("id"))
    known = o.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    b = table(spark, sf_dir, "lineitem").select("l_orderkey").distinct().join(known, "l_orderkey", "left_anti")
    return a.unionByName(b.select(F.lit("order").alias("rule"), F.col("l_orderkey").alias("id")))


@query("""with recursive n as (select s_suppkey as id, case when s_suppkey % 7 <> 0 then (s_suppkey * 3 + 1) % 100 end as parent, (select count(*) from supplier) as most from supplier),
w as (select id, parent as at, 1 as depth, most from n where parent is not null
 union all select w.id, n.parent as at, w.depth + 1 as depth, w.most from w join n on n.id = w.at where n.parent is not null and w.depth <= w.most)
select id, case when max(depth) <= max(most) then max(depth) end as depth, max(depth) > max(most) as in_cycle from w group by id""")
def parent_cycle_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features with a parent: the steps to the end of their walk over parents, or that it is in or leads into a cycle."""
    key = F.col("s_suppkey")
    return graph.walks(table(spark, sf_dir, "supplier").select(key.alias("id"), F.when(key % 7 != 0, (key * 3 + 1) % 100).alias("parent")))


@query(PRIMS + """, g as (select graph, count(distinct face) as required, list_sort(list(distinct face) filter (role = 'vis')) as d, list_sort(list(distinct face) filter (role = 'hid')) as h from p group by graph)
select graph, required, coalesce(len(d), 0) as determined, coalesce(len(h), 0) as by_geometry, required - coalesce(len(d), 0) - coalesce(len(h), 0) as missing, len(list_intersect(coalesce(d, []), coalesce(h, []))) = 0 as disjoint, round((coalesce(len(d), 0) + coalesce(len(h), 0)) / required, 4) as coverage from g""")
def dof_recompute(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = prims(spark, sf_dir)
    of = lambda r: F.collect_set(F.when(F.col("role") == r, F.col("face")))
    g = p.groupBy("graph").agg(F.count_distinct("face").alias("required"), of("vis").alias("d"), of("hid").alias("h"))
    d, h = F.size("d").cast("long"), F.size("h").cast("long")
    return g.select("graph", "required", d.alias("determined"), h.alias("by_geometry"), (F.col("required") - d - h).alias("missing"), (F.size(F.array_intersect("d", "h")) == 0).alias("disjoint"), F.round((d + h) / F.col("required"), 4).alias("coverage"))


@query(PRIMS + """, a as (select graph, view, count(*) as total, count(*) filter (role = 'vis') as visible, count(*) filter (role = 'hid') as hidden from p group by all)
select a.*, p_size as declared, total <> p_size as mismatch from a join part on p_partkey = graph""")
def census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by view against what the drawing declares."""
    a = prims(spark, sf_dir).groupBy("graph", "view").agg(F.count("*").alias("total"), F.count_if(F.col("role") == "vis").alias("visible"), F.count_if(F.col("role") == "hid").alias("hidden"))
    return a.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("graph"), F.col("p_size").alias("declared")), "graph").withColumn("mismatch", F.col("total") != F.col("declared"))


@query(PRIMS + "select graph, view, min(x) as lo, max(x + len) as hi, max(x + len) - min(x) as span from p where role = 'vis' group by all")
def dimension_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.col("x") + F.col("len")
    return prims(spark, sf_dir).where("role = 'vis'").groupBy("graph", "view").agg(F.min("x").alias("lo"), F.max(end).alias("hi"), (F.max(end) - F.min("x")).alias("span"))


@query(PRIMS + "select graph, max(greatest(abs(x) + r, abs(x + len), abs(y) + r)) as extent from p group by graph")
def quantization_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    reach = F.greatest(F.abs("x") + F.col("r"), F.abs(F.col("x") + F.col("len")), F.abs("y") + F.col("r"))
    return prims(spark, sf_dir).groupBy("graph").agg(F.max(reach).alias("extent"))


@query(PRIMS + "select graph, view, pi, x - min(case when role in ('vis', 'hid') then x - r end) over (partition by graph, view) as sx, y - min(y - r) over (partition by graph, view) as sy from p")
def content_min_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates after the minimum of the content has moved to 0."""
    view = Window.partitionBy("graph", "view")
    low = lambda c: F.min(F.col(c) - F.col("r")).over(view)
    return prims(spark, sf_dir).select("graph", "view", "pi", (F.col("x") - low("x")).alias("sx"), (F.col("y") - low("y")).alias("sy"))


@query(PRIMS + """, c as (select graph, view, y, pi, len, unnest(range(x, x + len)) as k from p where role = 'hid'),
v as (select distinct graph, view, y, unnest(range(x, x + len)) as k from p where role = 'vis')
select c.graph, c.pi, max(c.len) as len, count(v.k) = count(*) as is_covered from c left join v on v.graph = c.graph and v.view = c.view and v.y = c.y and v.k = c.k group by c.graph, c.pi""")
def interval_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hidden lines that collinear visible lines of their view cover together."""
    p, tol = prims(spark, sf_dir), 0.02
    on = ["graph", "view", "y"]
    seen = p.where("role = 'vis'").groupBy(*on).agg(F.collect_set(F.struct("x", "len")).alias("vis"))
    h = p.where("role = 'hid'").join(seen, on, "left")
    none = F.coalesce("vis", F.array().cast("array<struct<x:bigint,len:bigint>>"))
    parts = F.transform(none, lambda v: F.struct((v["x"] - F.col("x") - tol).cast("double").alias("a"), (v["x"] + v["len"] - F.col("x") + tol).cast("double").alias("b")))
    return h.select("graph", "pi", "len", drawing.covered(F.col("len").cast("double"), parts, tol).alias("is_covered"))


@query(PRIMS + """, m as (select h.graph, h.pi, arg_min(v.pi, (sqrt((h.x - v.x) * (h.x - v.x) + (h.y - v.y) * (h.y - v.y)) + abs(h.r - v.r), v.pi)) as match from p h join p v on h.graph = v.graph and h.view = v.view and h.role = 'hid' and v.role = 'vis'
 where sqrt((h.x - v.x) * (h.x - v.x) + (h.y - v.y) * (h.y - v.y)) + abs(h.r - v.r) < 4 + 0.15 * h.r group by all)
select p.graph, p.pi, m.match from p left join m on m.graph = p.graph and m.pi = p.pi where p.role = 'hid'""")
def nearest_under_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest visible circle of each hidden one by centre and radius, if it is near enough."""
    p = prims(spark, sf_dir)
    left = p.where("role = 'hid'").select("graph", "view", "pi", "x", "y", "r")
    right = p.where("role = 'vis'").select("graph", "view", F.col("pi").alias("match"), F.col("x").alias("vx"), F.col("y").alias("vy"), F.col("r").alias("vr"))
    dx, dy = F.col("x") - F.col("vx"), F.col("y") - F.col("vy")
    d = F.sqrt(dx * dx + dy * dy) + F.abs(F.col("r") - F.col("vr"))
    return drawing.nearest(left, right, ["graph", "view"], ["graph", "pi"], d, d < 4 + F.lit(0.15) * F.col("r"), "match", "match")


@query(PRIMS + """, b as (select graph, view, min(x) as lo, max(x + len) as hi from p where role = 'vis' group by all)
select graph, view, arg_min(pi, (abs(x - lo), len, pi)) as low_ref, arg_min(pi, (abs(x + len - hi), len, pi)) as high_ref from p join b using (graph, view) where role = 'vis' group by all""")
def extreme_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The primitives that a dimension's ends refer to."""
    v = prims(spark, sf_dir).where("role = 'vis'")
    end = F.col("x") + F.col("len")
    b = v.groupBy("graph", "view").agg(F.min("x").alias("lo"), F.max(end).alias("hi"))
    ref = lambda off: F.min_by("pi", F.struct(off, F.col("len"), F.col("pi")))
    return v.join(b, ["graph", "view"]).groupBy("graph", "view").agg(ref(F.abs(F.col("x") - F.col("lo"))).alias("low_ref"), ref(F.abs(end - F.col("hi"))).alias("high_ref"))


@query(PRIMS + """, j as (select h.graph, h.pi, v.face, min(v.pi) as first from p h join p v on h.graph = v.graph and h.view = v.view and h.y = v.y and h.role = 'hid' and v.role = 'vis' and h.x >= v.x and h.x + h.len <= v.x + v.len group by all)
select graph, pi, count(*) as n_origins, string_agg(face::varchar, ',' order by first) as origins from j group by all""")
def oracle_theta_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Origins of the oracle segments on which both ends of a line lie; the first of an id wins."""
    p = prims(spark, sf_dir)
    h = p.where("role = 'hid'").select("graph", "view", "y", "pi", "x", "len")
    v = p.where("role = 'vis'").select("graph", "view", "y", F.col("x").alias("vx"), F.col("len").alias("vl"), "face", F.col("pi").alias("vp"))
    on = (F.col("x") >= F.col("vx")) & (F.col("x") + F.col("len") <= F.col("vx") + F.col("vl"))
    j = h.join(v, ["graph", "view", "y"]).where(on).groupBy("graph", "pi", "face").agg(F.min("vp").alias("first"))
    m = drawing.merged(j, ["graph", "pi"], "first", "face")
    return m.select("graph", "pi", F.size("face").cast("long").alias("n_origins"), F.array_join(F.transform("face", lambda f: f.cast("string")), ",").alias("origins"))


# Samples of a line of length len: i of m = max(1, floor(len * 10 / 6)) steps; m times a sample's x, in tenths, is a whole number, and so are all squares compared.
def _coverage(a: str, b: str) -> str:
    return f"""select s.graph, s.pi, s.len, s.m, s.i, coalesce(bool_or(pow(greatest(v.x * 10 * m - px, px - (v.x + v.len) * 10 * m, 0), 2) + pow((s.y - v.y) * 10 * m, 2) < 49 * m * m), false) as hit
 from (select *, x * 10 * m + len * 10 * i as px from (select *, unnest(range(m + 1)) as i from (select *, greatest(1, len * 10 // 6)::bigint as m from p where role = '{a}'))) s
 left join (select * from p where role = '{b}') v on v.graph = s.graph and v.view = s.view group by all"""


def _shares(c: str) -> str:
    return f"""select graph, (sum(hits * 1000000 // (m + 1) * len)::bigint // sum(len)::bigint) / 1000000 as share from (select graph, pi, len, m, count(*) filter (hit) as hits from ({c}) group by all) group by graph"""


@query(PRIMS + f"""select graph, t.share as recall, q.share as precision from ({_shares(_coverage('hid', 'vis'))}) t full join ({_shares(_coverage('vis', 'hid'))}) q using (graph)""")
def line_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length-weighted share of the lines of one side, sampled every 6 units at most, that lies within 7 of a line of the other side in the view: recall and precision."""
    p = written(prims(spark, sf_dir), "prims").select("graph", "view", "role", "pi", "x", "y", "len")

    def share(a: str, b: str, name: str) -> DataFrame:
        m, i = F.col("m"), F.col("i")
        # Lines are dealt out by view, before they are sampled; samples, what they meet and their sums stay there.
        s = p.where(F.col("role") == a).repartition("graph", "view").withColumn("m", F.greatest(F.lit(1), F.floor(F.col("len") * 10 / 6)).cast("long")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m"))))
        s = s.select("graph", "view", "pi", "y", "len", "m", "i", (F.col("x") * 10 * m + F.col("len") * 10 * i).alias("px"))
        v = p.where(F.col("role") == b).repartition("graph", "view").select("graph", "view", F.col("x").alias("vx"), F.col("y").alias("vy"), F.col("len").alias("vl"))
        dx = F.greatest(F.col("vx") * 10 * m - F.col("px"), F.col("px") - (F.col("vx") + F.col("vl")) * 10 * m, F.lit(0))
        dy = (F.col("y") - F.col("vy")) * 10 * m
        hit = F.coalesce(F.bool_or(dx * dx + dy * dy < 49 * m * m), F.lit(False))
        c = s.join(v.hint("merge"), ["graph", "view"], "left").groupBy("graph", "view", "pi", "len", "m", "i").agg(hit.alias("hit"))
        line = c.groupBy("graph", "view", "pi", "len", "m").agg(F.count_if("hit").alias("hits"))
        whole = line.groupBy("graph").agg(F.sum(F.expr("hits * 1000000 div (m + 1) * len")).alias("sum"), F.sum("len").alias("len"))
        return whole.select("graph", (F.expr("sum div len") / 1_000_000).alias(name))

    return share("hid", "vis", "recall").join(share("vis", "hid", "precision"), "graph", "full")


@query(PRIMS + "select graph, count(*) as n_votes, round(median(x / r), 6) as px_per_mm, round(stddev_pop(x / r) / median(x / r), 6) as spread from p group by graph")
def scale_selfcheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median of the votes of a drawing's bound diameters and how far they spread."""
    p = prims(spark, sf_dir).withColumn("v", F.col("x") / F.col("r"))
    h = stats.histogram(p, ["graph"], "v", spread=False).groupBy("graph").agg(stats.true_median("v").alias("m"))
    d = p.groupBy("graph").agg(F.count("*").alias("n_votes"), F.stddev_pop("v").alias("s")).join(h, "graph")
    return d.select("graph", "n_votes", F.round("m", 6).alias("px_per_mm"), F.round(F.col("s") / F.col("m"), 6).alias("spread"))


@query(PRIMS + """, c as (select graph, face, pi, unnest([x - r, x + r]) as e from p where view = 'A'), l as (select graph, face, x from p where view = 'N'),
m as (select c.graph, c.pi, c.e, min(abs(c.e - l.x)) as dev from c left join l on l.graph = c.graph and l.face = c.face group by all)
select graph, max(dev) as max_dev, count(dev) as matched, count(*) - count(dev) as unmatched from m group by graph""")
def crossview_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both edges of each circle against the nearest line with its tag in the other view."""
    p = prims(spark, sf_dir)
    edges = F.explode(F.array(F.col("x") - F.col("r"), F.col("x") + F.col("r")))
    c = p.where("view = 'A'").select("graph", "face", "pi", edges.alias("e"))
    lines = p.where("view = 'N'").select("graph", "face", F.col("x").alias("lx"))
    m = c.join(lines, ["graph", "face"], "left").groupBy("graph", "pi", "e").agg(F.min(F.abs(F.col("e") - F.col("lx"))).alias("dev"))
    return m.groupBy("graph").agg(F.max("dev").alias("max_dev"), F.count("dev").alias("matched"), (F.count("*") - F.count("dev")).alias("unmatched"))


@query(PRIMS + "select graph, x // 4 as bucket, y, arg_max(pi, (r, -pi)) as outer_pi, max(r) as r from p group by all")
def outer_circle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prims(spark, sf_dir).groupBy("graph", F.floor(F.col("x") / 4).cast("long").alias("bucket"), "y").agg(F.max_by("pi", F.struct("r", -F.col("pi"))).alias("outer_pi"), F.max("r").alias("r"))


@query(PRIMS + "select graph, r, 'cyl' || (dense_rank() over (partition by graph order by min(pi)) - 1) as id, min(pi) as first_pi, string_agg(distinct face::varchar, ',' order by face::varchar) as faces from p where r > 0 and r <= 50 and x between 2 and 48 group by graph, r")
def cylinder_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sane cylinders by radius: the first wins, all faces are kept."""
    p = prims(spark, sf_dir).where("r > 0 and r <= 50 and x between 2 and 48")
    g = p.groupBy("graph", "r").agg(F.min("pi").alias("first_pi"), F.array_join(F.sort_array(F.collect_set(F.col("face").cast("string"))), ",").alias("faces"))
    n = F.dense_rank().over(Window.partitionBy("graph").orderBy("first_pi")) - 1
    return g.withColumn("id", F.concat(F.lit("cyl"), n.cast("string")))


_SCAN = "((({x}) - 20) * cos(radians(turn)) - (({y}) - 2) * sin(radians(turn))) * 1.25::double + 20 + 3 as {u}, ((({x}) - 20) * sin(radians(turn)) + (({y}) - 2) * cos(radians(turn))) * 1.25::double + 2 - 1 as {v}"


@query(PRIMS + f""", q as (select *, graph % 5 * 7 as turn, y * 6 as yy from p), b as (select graph, turn, min(x) - 5.3::double as x0, max(x + len) + 5.3::double as x1, min(yy) - 5.3::double as y0, max(yy + r) + 5.3::double as y1 from q where role = 'vis' group by all),
k as (select graph, turn, unnest([x0, x1, x1, x0]) as cx, unnest([y0, y0, y1, y1]) as cy from b), m as (select graph, {_SCAN.format(x='cx', y='cy', u='u', v='v')} from k), g as (select graph, min(u) as u0, max(u) as u1, min(v) as v0, max(v) as v1 from m group by graph),
d as (select graph, {_SCAN.format(x='x + r', y='yy + 2 * len', u='u', v='v')} from q)
select d.graph, count(*) as n, count(*) filter (u0 is null or (u between u0 and u1 and v between v0 and v1)) as n_inside from d left join g using (graph) group by d.graph""")
def region_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections in the region that labels span, widened, both in the coordinates of a turned and scaled scan: of the region the box around its mapped corners; without labels everything is inside."""
    turn = F.radians(F.col("graph") % 5 * 7)

    def scan(x: Column, y: Column) -> tuple[Column, Column]:
        x, y = x - 20, y - 2
        return (x * F.cos(turn) - y * F.sin(turn)) * 1.25 + 23, (x * F.sin(turn) + y * F.cos(turn)) * 1.25 + 1

    p = written(prims(spark, sf_dir).withColumn("yy", F.col("y") * 6), "prims")
    box = {"x0": F.min("x") - 5.3, "x1": F.max(F.col("x") + F.col("len")) + 5.3, "y0": F.min("yy") - 5.3, "y1": F.max(F.col("yy") + F.col("r")) + 5.3}
    b = p.where("role = 'vis'").groupBy("graph").agg(*[c.alias(k) for k, c in box.items()])
    corners = [scan(F.col(x), F.col(y)) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))]
    region = b.select("graph", *[f(*[c[i] for c in corners]).alias(f"{k}{j}") for i, k in enumerate("uv") for j, f in enumerate((F.least, F.greatest))])
    u, v = scan(F.col("x") + F.col("r"), F.col("yy") + 2 * F.col("len"))
    d = p.select("graph", u.alias("u"), v.alias("v")).join(region, "graph", "left")
    inside = F.col("u0").isNull() | (F.col("u").between(F.col("u0"), F.col("u1")) & F.col("v").between(F.col("v0"), F.col("v1")))
    return d.groupBy("graph").agg(F.count("*").alias("n"), F.count_if(inside).alias("n_inside"))


@query(PRIMS + "select case when r < 3 then '1-3' when r < 6 then '3-6' else '6-' end as band, count(*) as n, count(*) filter (role = 'vis') as n_hit, round(count(*) filter (role = 'vis') / count(*), 6) as recall from p group by 1")
def radius_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = rules.first_of({"1-3": F.col("r") < 3, "3-6": F.col("r") < 6}, "6-")
    hit = F.count_if(F.col("role") == "vis")
    return prims(spark, sf_dir).groupBy(band.alias("band")).agg(F.count("*").alias("n"), hit.alias("n_hit"), F.round(hit / F.count("*"), 6).alias("recall"))


@query(PRIMS + "select graph, count(*) filter (kind = 'degenerate') as n_degenerate, count(*) filter (kind = 'duplicate') as n_duplicate, count(*) filter (kind = 'kept') as n_kept from (select graph, case when len = 1 then 'degenerate' when row_number() over (partition by graph, view, role, least(x, x + len), greatest(x, x + len), y, len = 1 order by pi) > 1 then 'duplicate' else 'kept' end as kind from p) group by graph")
def reject_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degenerate primitives and repeats of a signature (ends in either order), counted; the first stays."""
    p = prims(spark, sf_dir).withColumn("end", F.col("x") + F.col("len")).withColumn("flat", F.col("len") == 1)
    n = selection.numbered(p.withColumns({"lo": F.least("x", "end"), "hi": F.greatest("x", "end")}), ["graph", "view", "role", "lo", "hi", "y", "flat"], ["pi"])
    kind = rules.first_of({"degenerate": F.col("flat"), "duplicate": F.col("n") > 1}, "kept")
    is_ = lambda v: F.count_if(F.col("kind") == v).alias(f"n_{v}")
    return n.withColumn("kind", kind).groupBy("graph").agg(is_("degenerate"), is_("duplicate"), is_("kept"))


@query(PRIMS + "select graph, min(least(x, x - r)) - 30 as x0, min(y - r) - 30 as y0, max(greatest(x + len, x + r)) + 30 as x1, max(y + r) + 30 as y1 from p group by graph")
def gt_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = prims(spark, sf_dir)
    x, y, r = F.col("x"), F.col("y"), F.col("r")
    return p.groupBy("graph").agg((F.min(F.least(x, x - r)) - 30).alias("x0"), (F.min(y - r) - 30).alias("y0"), (F.max(F.greatest(x + F.col("len"), x + r)) + 30).alias("x1"), (F.max(y + r) + 30).alias("y1"))


@query(PRIMS + """, c as (select graph, pi, greatest(x + r, x + len) as c from p), e as (select graph, max(c) - 1 as ext from c group by graph)
select graph, arg_min(pi, (abs(c - ext), -c, pi)) as pi, arg_min(c, (abs(c - ext), -c, pi)) as contribution from c join e using (graph) group by graph""")
def max_contributor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contribution nearest to the recorded extent, the larger of equals."""
    c = prims(spark, sf_dir).select("graph", "pi", F.greatest(F.col("x") + F.col("r"), F.col("x") + F.col("len")).alias("c"))
    e = c.groupBy("graph").agg((F.max("c") - 1).alias("ext"))
    best = F.min(F.struct(F.abs(F.col("c") - F.col("ext")), -F.col("c"), F.col("pi"), F.col("c").alias("v")))
    return c.join(e, "graph").groupBy("graph").agg(best.alias("b")).select("graph", F.col("b.pi").alias("pi"), F.col("b.v").alias("contribution"))
