"""Gates, predicates and censuses over the primitives that line items stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plateworks.operators import rules
from plateworks.plans.graphs import PRIMS, prims
from plateworks.plans.registry import query
from plateworks.shared import written


@query(PRIMS + """select graph, 'coords' as gate, count(*) as n from p where len = 1 group by graph
union all select graph, 'frame' as gate, count(*) as n from p where x < 2 group by graph
union all select graph, 'provenance' as gate, count(*) as n from p where face = 0 and role = 'hid' group by graph""")
def gate_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations by drawing and gate: each primitive is tested once for all gates."""
    tests = {"coords": F.col("len") == 1, "frame": F.col("x") < 2, "provenance": (F.col("face") == 0) & (F.col("role") == "hid")}
    hit = prims(spark, sf_dir).select("graph", F.explode(rules.reasons(tests)).alias("gate"))
    return hit.groupBy("graph", "gate").agg(F.count("*").alias("n"))


@query(PRIMS + """, s as (select graph, pi, x::double as x1, y * 10.0::double as y1, (x + len - 1)::double as x2, (y * 10 + face % 3 * (len - 1))::double as y2, 25.25::double as px, r * 1.5::double + 0.25 as py from p), q as (select *, (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) as sq from s),
t as (select *, case when sq < 1e-6 then null else ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / sq end as t from q)
select graph, pi, sq < 1e-6 as is_point, case when sq < 1e-6 then sqrt((px - x1) ** 2 + (py - y1) ** 2) < 2.1::double else t >= -0.1::double and t <= 1.1::double and sqrt((px - x1 - t * (x2 - x1)) ** 2 + (py - y1 - t * (y2 - y1)) ** 2) < 2.1::double end as on_segment from t""")
def segment_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a point lies on a segment of any direction, a share past its ends included, or near one that is a point."""
    x, y, n = F.col("x").cast("double"), F.col("y") * 10.0, F.col("len") - 1
    x2, y2, px, py = x + n, y + F.col("face") % 3 * n, F.lit(25.25), F.col("r") * 1.5 + 0.25
    dx, dy = x2 - x, y2 - y
    square = dx * dx + dy * dy
    t = ((px - x) * dx + (py - y) * dy) / F.nullif(square, F.lit(0.0))
    beside = F.hypot(px - x - t * dx, py - y - t * dy) < 2.1
    on = F.when(square < 1e-6, F.hypot(px - x, py - y) < 2.1).otherwise((t >= -0.1) & (t <= 1.1) & beside)
    return prims(spark, sf_dir).select("graph", "pi", (square < 1e-6).alias("is_point"), on.alias("on_segment"))


@query(PRIMS + """, v as (select graph, view, min(x) as x0, max(x + len) as x1, min(y * 4) as y0, max(y * 4 + r) as y1 from p where role = 'vis' group by all), w as (select *, greatest(5, 0.15::double * sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2)) as m from v)
select p.graph, count(*) filter (p.x + p.r between x0 - m and x1 + m and p.y * 4 + 3 * p.len between y0 - m and y1 + m) as n_inside, count(*) as n from p join w on p.graph = w.graph and p.view = w.view where p.role = 'hid' group by p.graph""")
def centre_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centre marks that lie in their view along both axes, widened by a share of its diagonal."""
    p = written(prims(spark, sf_dir), "prims")
    x, y = F.col("x"), F.col("y") * 4
    box = {"x0": F.min(x), "x1": F.max(x + F.col("len")), "y0": F.min(y), "y1": F.max(y + F.col("r"))}
    v = p.where("role = 'vis'").groupBy("graph", "view").agg(*[c.alias(k) for k, c in box.items()])
    margin = F.greatest(F.lit(5.0), 0.15 * F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))
    within = lambda c, k: c.between(F.col(f"{k}0") - margin, F.col(f"{k}1") + margin)
    inside = within(x + F.col("r"), "x") & within(y + 3 * F.col("len"), "y")
    return p.where("role = 'hid'").join(v, ["graph", "view"]).groupBy("graph").agg(F.count_if(inside).alias("n_inside"), F.count("*").alias("n"))


@query(PRIMS + "select graph, pi, x - r as x0, y - r as y0, greatest(x + len, x + r) as x1, y + r as y1 from p")
def prim_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, r = F.col("x"), F.col("y"), F.col("r")
    return prims(spark, sf_dir).select("graph", "pi", (x - r).alias("x0"), (y - r).alias("y0"), F.greatest(x + F.col("len"), x + r).alias("x1"), (y + r).alias("y1"))


@query(PRIMS + """, u as (select graph, view, role, x, y, len, count(*) as n from p group by all), o as (select graph, count(*) as n_out, sum(n - 1)::bigint as n_merged from u group by graph), s as (select graph, count(*) as n_source from p group by graph)
select graph, n_source, n_out, n_merged, n_source = n_out + n_merged as balances from s join o using (graph)""")
def roundtrip_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is emitted and what was merged add up to the source."""
    p = prims(spark, sf_dir)
    u = p.groupBy("graph", "view", "role", "x", "y", "len").agg(F.count("*").alias("n"))
    o = u.groupBy("graph").agg(F.sum("n").alias("n_source"), F.count("*").alias("n_out"), F.sum(F.col("n") - 1).alias("n_merged"))
    return o.withColumn("balances", F.col("n_source") == F.col("n_out") + F.col("n_merged"))


@query(PRIMS + "select graph, pi, case when role = 'hid' and len > 8 then 'long hidden line' when r > 6 then 'large circle' when view = 'R' then 'side view' else 'other' end as cause from p")
def failure_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = {"long hidden line": (F.col("role") == "hid") & (F.col("len") > 8), "large circle": F.col("r") > 6, "side view": F.col("view") == "R"}
    return prims(spark, sf_dir).select("graph", "pi", rules.first_of(tests, "other").alias("cause"))


@query(PRIMS + ", c as (select graph, count(*) filter (r > 4) as n from p group by graph) select round(avg(n), 6) as mean, median(n)::double as median, min(n) as low, max(n) as high, count(*) as n_parts from c")
def circle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Circles a part over all parts."""
    c = prims(spark, sf_dir).groupBy("graph").agg(F.count_if(F.col("r") > 4).alias("n"))
    return c.agg(F.round(F.avg("n"), 6).alias("mean"), F.median("n").alias("median"), F.min("n").alias("low"), F.max("n").alias("high"), F.count("*").alias("n_parts"))


@query(PRIMS + "select graph, pi, 'V|' || view || '|' || pi || '|' || x || '|' || coalesce(case when role = 'vis' then r::varchar end, '-') as line from p")
def pipe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with fields between pipes and a dash for null, read back before they are returned."""
    p = prims(spark, sf_dir).withColumn("radius", F.when(F.col("role") == "vis", F.col("r")))
    line = F.concat_ws("|", F.lit("V"), "view", F.col("pi").cast("string"), F.col("x").cast("string"), F.coalesce(F.col("radius").cast("string"), F.lit("-")))
    cut = F.split("line", r"\|")
    back = p.select("graph", "pi", "radius", line.alias("line")).withColumn("read", F.nullif(cut[4], F.lit("-")).cast("long"))
    return back.where(F.col("read").eqNullSafe(F.col("radius"))).select("graph", "pi", "line")
