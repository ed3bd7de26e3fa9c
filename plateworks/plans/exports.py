"""Drawings as entities of two dialects, the full score report, and bundles of several variants.

On adapters of the given tables, as in plans.graphs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plateworks.operators import bundles, emit, kernels, stats
from plateworks.plans.graphs import PRIMS, prims
from plateworks.plans.registry import query
from plateworks.shared import written
from plateworks.sources import table

_HEIGHT = 64
_E = PRIMS + """, e as (select graph, view, pi, ['line', 'circle', 'arc', 'spline'][(pi % 4 + 1)::int] as type, case when role = 'hid' then 'hidden' when face % 5 = 0 then 'center' else 'visible' end as role,
 x::double as x, y * 8.0::double as y, len / 2.0::double as len, r / 2.0::double as r, (face * 90)::double as a1, case when face % 7 > 0 then (face * 90 + 90 * (1 + r % 3))::double end as a2, face from p)
"""
_P = "printf('%.{1}f', {0})"


def _p(v: str, places: int = 4) -> str:
    return _P.format(f"(({v})::double + 0.0)", places)  # no negative zero


_ARC = " || ' ' || ".join(_p(f"{c} + r * round({f}(radians(a1)))") for c, f in (("x", "cos"), ("y", "sin")))
_ARC_END = " || ' ' || ".join(_p(f"{c} + r * round({f}(radians(a2)))") for c, f in (("x", "cos"), ("y", "sin")))


def _svg_line(kind: str, *c: str) -> str:
    return f"'<line class=\"{kind}\" x1=\"' || {_p(c[0], 2)} || '\" y1=\"' || {_p(c[1], 2)} || '\" x2=\"' || {_p(c[2], 2)} || '\" y2=\"' || {_p(c[3], 2)} || '\"/>'"


@query(_E + f""", d as (select graph, pi, case when type = 'arc' and a2 is null then 'ARC' when role = 'hidden' then 'HIDDEN' when role = 'center' then 'CENTER' else 'VISIBLE' end as layer,
 case type when 'line' then 'LINE ' || {_p('x', 2)} || ' ' || {_p(f'{_HEIGHT} - y', 2)} || ' ' || {_p('x + len', 2)} || ' ' || {_p(f'{_HEIGHT} - y - len', 2)}
  when 'circle' then 'CIRCLE ' || {_p('x', 2)} || ' ' || {_p(f'{_HEIGHT} - y', 2)} || ' ' || {_p('r', 2)}
  when 'arc' then case when a2 is null then 'CIRCLE ' else 'ARC ' end || {_p('x', 2)} || ' ' || {_p(f'{_HEIGHT} - y', 2)} || ' ' || {_p('r', 2)} || case when a2 is null then '' else ' ' || {_p('-a2', 2)} || ' ' || {_p('-a1', 2)} end end as dxf,
 case type when 'line' then 'M ' || {_p('x')} || ' ' || {_p('y')} || ' L ' || {_p('x + len')} || ' ' || {_p('y + len')}
  else case when type = 'arc' and a2 is not null then 'M ' || {_ARC} || ' A ' || {_p('r')} || ' ' || {_p('r')} || ' 0 ' || case when (a2 - a1) % 360 > 180 then '1' else '0' end || ' 1 ' || {_ARC_END}
  else 'M ' || {_p('x - r')} || ' ' || {_p('y')} || ' A ' || {_p('r')} || ' ' || {_p('r')} || ' 0 1 0 ' || {_p('x + r')} || ' ' || {_p('y')} || ' A ' || {_p('r')} || ' ' || {_p('r')} || ' 0 1 0 ' || {_p('x - r')} || ' ' || {_p('y')} || ' Z' end end as path, role from e where type <> 'spline')
select graph, count(*) as n_entities, count(*) filter (layer = 'HIDDEN') as n_hidden, count(*) filter (layer = 'ARC') as n_open, md5(string_agg(layer || ' ' || dxf, chr(10) order by pi)) as dxf,
 md5(string_agg('<path class="' || case when role = 'hidden' then 'hidden' else 'visible' end || '" d="' || path || '"/>', chr(10) order by role <> 'hidden', pi)) as svg from d group by graph""")
def drawing_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each drawing's primitives as DXF entities by layer, y turned around, and as SVG paths, hidden ones first: counts and digests."""
    types = F.element_at(F.array(*map(F.lit, ("line", "circle", "arc", "spline"))), (F.col("pi") % 4 + 1).cast("int"))
    role = F.when(F.col("role") == "hid", "hidden").when(F.col("face") % 5 == 0, "center").otherwise("visible")
    n, turn = F.col("len") / 2, F.col("face") * 90
    p = prims(spark, sf_dir).select(
        "graph", "pi", types.alias("type"), role.alias("role"), F.col("x").alias("x1"), (F.col("y") * 8).alias("y1"), (F.col("x") + n).alias("x2"), (F.col("y") * 8 + n).alias("y2"), F.col("x").alias("cx"), (F.col("y") * 8).alias("cy"),
        (F.col("r") / 2).alias("r"), turn.alias("a1"), F.when(F.col("face") % 7 > 0, turn + 90 * (1 + F.col("r") % 3)).alias("a2"),
    )
    d = emit.dxf(p, F.lit(_HEIGHT)).where("entity is not null").withColumn("path", emit.svg_path())
    two = lambda *names: F.concat_ws(" ", *[F.format_string("%.2f", F.col(f"entity.{x}")) for x in names])
    kind = F.col("entity.kind")
    body = F.concat(kind, F.lit(" "), F.when(kind == "LINE", two("x1", "y1", "x2", "y2")).when(kind == "CIRCLE", two("x1", "y1", "r")).otherwise(two("x1", "y1", "r", "start", "stop")))
    # No negative zero in a text.
    tidy = lambda c: F.regexp_replace(c, r"-(0\.0+)(?![0-9])", "$1")
    joined = lambda c: F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda s: s["t"]), "\n").cast("binary"))
    dxf = F.struct("pi", F.concat("layer", F.lit(" "), tidy(body)).alias("t"))
    svg = F.struct((F.col("role") != "hidden").alias("o"), "pi", emit.svg_element(F.col("role"), tidy(F.col("path"))).alias("t"))
    return d.groupBy("graph").agg(F.count("*").alias("n_entities"), F.count_if(F.col("layer") == "HIDDEN").alias("n_hidden"), F.count_if(F.col("layer") == "ARC").alias("n_open"), joined(dxf).alias("dxf"), joined(svg).alias("svg"))


@query(_E + f""", a as (select graph, pi as ord, case face % 3 when 0 then 'diameter' when 1 then 'radius' else 'linear' end as kind, r * 2.25::double as value, case when face = 11 then 3.0::double end as tx, case when face = 11 then 5.0::double end as ty, [pi + 5000, pi + 1, pi] as refs from e where face % 2 = 1),
q as (select graph, pi, case when type = 'line' then x else x + r + 10 end as px, y as py from e where type <> 'spline'),
f as (select graph, ord, arg_min(struct_pack(x := px, y := py), list_position(refs, pi)) as pt from a join q using (graph) where list_contains(refs, pi) group by all)
select a.graph, a.ord, case kind when 'diameter' then 'Ø' when 'radius' then 'R' else '' end || regexp_replace(printf('%.6f', value), '\\.?0+$', '') as label, coalesce(tx, pt.x, 20) as x, {_HEIGHT} - coalesce(ty, pt.y, 20 + a.ord * 30) as y from a left join f using (graph, ord)""")
def label_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the labels of annotations go: their own place, beside what they refer to, or the corner."""
    types = F.element_at(F.array(*map(F.lit, ("line", "circle", "arc", "spline"))), (F.col("pi") % 4 + 1).cast("int"))
    p = written(prims(spark, sf_dir), "prims").withColumns({"y": F.col("y") * 8, "r": F.col("r") / 2, "type": types})
    flat = F.col("type") != "spline"
    shapes = p.select("graph", F.col("pi").alias("id"), "type", F.col("x").alias("x1"), F.col("y").alias("y1"), F.when(flat, F.col("x")).alias("cx"), F.when(flat, F.col("y")).alias("cy"), "r")
    kind = F.when(F.col("face") % 3 == 0, "diameter").when(F.col("face") % 3 == 1, "radius").otherwise("linear")
    own = lambda v: F.when(F.col("face") == 11, F.lit(v))
    notes = p.where("face % 2 = 1").select("graph", F.col("pi").alias("ord"), kind.alias("kind"), (F.col("r") * 2.25).alias("value"), own(3.0).alias("text_x"), own(5.0).alias("text_y"), F.array(F.col("pi") + 5000, F.col("pi") + 1, "pi").alias("refs"))
    return emit.labels(notes, shapes, "graph", F.lit(float(_HEIGHT)))


def _dim_sql(across: bool) -> str:
    flip = (lambda u, v: (u, v)) if across else (lambda u, v: (v, u))
    lo, hi = "least(a, b)", "greatest(a, b)"
    arrow = lambda x, y, dx, dy: f"'<polygon points=\"' || {_p(x, 2)} || ',' || {_p(y, 2)} || ' ' || {_p(f'{x} - 6 * {dx} - {dy} * 1.92::double', 2)} || ',' || {_p(f'{y} - 6 * {dy} + {dx} * 1.92::double', 2)} || ' ' || {_p(f'{x} - 6 * {dx} + {dy} * 1.92::double', 2)} || ',' || {_p(f'{y} - 6 * {dy} - {dx} * 1.92::double', 2)} || '\" fill=\"black\"/>'"
    ways = (("(-1)", "0"), ("1", "0")) if across else (("0", "(-1)"), ("0", "1"))
    tx, ty = ("(a + b) / 2", "t - 1.4::double") if across else ("t - 1.4::double", "(a + b) / 2")
    turned = "''" if across else f"' transform=\"rotate(-90 ' || {_p(tx, 2)} || ' ' || {_p(ty, 2)} || ')\"'"
    said = f"'<text class=\"dimtxt\" x=\"' || {_p(tx, 2)} || '\" y=\"' || {_p(ty, 2)} || '\" text-anchor=\"middle\"' || {turned} || '>' || p_size || '</text>'"
    parts = [_svg_line("ext", *flip(x, "g + s * 2"), *flip(x, "t + s * 9")) for x in "ab"] + [_svg_line("dim", *flip(lo, "t"), *flip(hi, "t"))]
    parts += [arrow(*flip(x, "t"), *w) for x, w in zip((lo, hi), ways, strict=True)] + [said]
    return " || chr(10) || ".join(parts)


@query(f"""with d as (select p_partkey, p_size, p_partkey % 50 / 2.0::double as a, p_size * 3 / 2.0::double as b, (p_size % 7)::double as g, (p_partkey % 20 - 8)::double as t from part), e as (select *, case when t > g then 1 else -1 end as s from d)
select p_partkey, md5({_dim_sql(True)}) as across, md5({_dim_sql(False)}) as upright, md5({_svg_line('center', 'a - (b + 2.5::double)', 'g', 'a + (b + 2.5::double)', 'g')} || chr(10) || {_svg_line('center', 'a', 'g - (b + 2.5::double)', 'a', 'g + (b + 2.5::double)')}) as cross from e""")
def dimension_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SVG of a horizontal and a vertical dimension and of a centre's cross, for each part."""
    k, s = F.col("p_partkey"), F.col("p_size")
    p = table(spark, sf_dir, "part").select("p_partkey", (k % 50 / 2).alias("a"), (s * 3 / 2).alias("b"), (s % 7).cast("double").alias("g"), (k % 20 - 8).cast("double").alias("t"), s.cast("string").alias("text"))
    a, b, g, t = (F.col(c) for c in "abgt")
    md5 = lambda c: F.md5(F.regexp_replace(c, r"-(0\.0+)(?![0-9])", "$1").cast("binary"))
    return p.select("p_partkey", *[md5(emit.dimension(a, b, g, t, F.col("text"), x)).alias(n) for n, x in (("across", True), ("upright", False))], md5(emit.centre_cross(a, g, b)).alias("cross"))


_TAKE = "list_reduce(c, lambda a, e: case when list_bool_or(list_transform(a, lambda k: k.g = e[1].g or k.p = e[1].p)) then a else a || e end)"


def _take(name: str, of: str, by: str, order: str, more: str = "") -> str:
    return f"{name} as (select {by}, unnest({_TAKE}) as e from (select {by}, list([struct_pack(g := gt, p := pred{more})] order by {order}) as c from {of} group by all))"


@query(PRIMS + f""", b as (select graph, view, pi, role, case pi % 3 when 0 then 'line' when 1 then 'circle' else 'arc' end as type, unnest(['all', case when face % 3 = 0 then 'hidden' else 'visible' end]) as scope, x, y, r, len, face from p),
t as (select graph, view, scope, pi as gt, type, x, y, r, len, face from b where role = 'vis'), q as (select graph, view, scope, pi as pred, type as pt, x as px, y as py, r as pr, len as pl, face as pf from b where role = 'hid'),
cc as (select *, sqrt((x - px) ** 2 + (y - py) ** 2) as d from t join q using (graph, view, scope) where type <> 'line' and pt <> 'line' and sqrt((x - px) ** 2 + (y - py) ** 2) < 3.5 and abs(r - pr) < greatest(1.8::double, 0.25::double * r)),
lc as (select * from t join q using (graph, view, scope) where type = 'line' and pt = 'line' and y = py and ((abs(x - px) < 3 and abs(x + len - px - pl) < 3) or (abs(x - px - pl) < 3 and abs(x + len - px) < 3))),
dc as (select *, 2 * r + x % 5 / 10.0::double as v, 2 * pr + px % 5 / 10.0::double as pv from t join q using (graph, view, scope) where scope = 'all' and face % 4 < 2 and pf % 4 < 2 and abs(2 * r + x % 5 / 10.0::double - 2 * pr - px % 5 / 10.0::double) <= greatest(0.6::double, 0.02::double * abs(2 * r + x % 5 / 10.0::double))),
{_take('cm', 'cc', 'graph, view, scope', 'gt, d, pred', ', same := type = pt')}, {_take('lm', 'lc', 'graph, view, scope', 'gt, pred')},
{_take('dm', 'dc', 'graph, view', 'gt, case when face % 3 = pf % 3 then -pred else pred + 1000000 end', ', kind := face % 3, same := face % 3 = pf % 3, err := abs(v - pv)')},
n as (select view, 'curve' as part, scope, count(*) filter (role = 'vis') as n_gt, count(*) filter (role = 'hid') as n_pred from b where type <> 'line' group by all union all select view, 'line', scope, count(*) filter (role = 'vis'), count(*) filter (role = 'hid') from b where type = 'line' group by all
 union all select view, 'dimension', 'all', count(*) filter (role = 'vis'), count(*) filter (role = 'hid') from b where scope = 'all' and face % 4 < 2 group by all),
k as (select graph, view, e.g as gt, e.p as pred from cm where scope = 'all'),
ok as (select dm.view, e.kind as kind, e.same as same, e.err as err, exists (select 1 from k where k.graph = dm.graph and k.view = dm.view and ((k.pred = e.p and k.gt in (e.g, e.g + 1)) or (k.pred = e.p + 1 and k.gt in (e.g, e.g + 1)))) as linked from dm),
m as (select view, 'curve' as part, scope, count(*) as tp, round(count(*) filter (e.same) / count(*), 3) as type_rate, null::double as diameter_mae, null::bigint as link_ok, null::bigint as link_total from cm group by all union all select view, 'line', scope, count(*), null, null, null, null from lm group by all
 union all select view, 'dimension', 'all', count(*), round(count(*) filter (same) / count(*), 3), round(sum(case when kind = 0 then round(err * 10)::bigint end) / 10.0::double / nullif(count(*) filter (kind = 0), 0), 3), count(*) filter (kind < 2 and linked), count(*) filter (kind < 2) from ok group by all),
j as (select n.*, coalesce(tp, 0)::bigint as tp, type_rate, diameter_mae, link_ok, link_total from n left join m using (view, part, scope))
select view, part, scope, n_gt, n_pred, tp, round(coalesce(tp / nullif(n_pred, 0), 0), 3) as precision, round(coalesce(tp / nullif(n_gt, 0), 0), 3) as recall, round(case when tp > 0 then 2 * (tp / n_pred) * (tp / n_gt) / (tp / n_pred + tp / n_gt) else 0 end, 3) as f1,
 type_rate, diameter_mae, link_ok, link_total, round(link_ok / nullif(link_total, 0), 3) as link_acc from j""")
def score_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score report of curves (circles and arcs), lines and dimensions, over all, visible and hidden ones: matches, rates, agreement of types, error of diameters, and dimensions whose references lead to the right curves.

    Hidden primitives stand for predictions; what is visible among either side is told by the face. Both sides grow with the input and Parquet
    files tell far less than their size in memory, so they are merged and never broadcast.
    """
    p = written(prims(spark, sf_dir), "prims")
    pi, face = F.col("pi"), F.col("face")
    kind = F.when(pi % 3 == 0, "line").when(pi % 3 == 1, "circle").otherwise("arc")
    both = p.select("graph", "view", "role", "pi", kind.alias("type"), "x", "y", "r", "len", "face", (2 * F.col("r") + F.col("x") % 5 / 10).alias("v"), F.explode(F.array(F.lit("all"), F.when(face % 3 == 0, "hidden").otherwise("visible"))).alias("scope"))
    by = ["graph", "view", "scope"]
    t = both.where("role = 'vis'").withColumnRenamed("pi", "gt").drop("role")
    q = both.where("role = 'hid'").select(*by, F.col("pi").alias("pred"), *[F.col(c).alias(f"p{c}") for c in ("type", "x", "y", "r", "len", "face", "v")])
    pairs = t.join(q.hint("merge"), by)
    curve, line = lambda c: F.col(c) != "line", lambda c: F.col(c) == "line"
    d = F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py"))
    near = curve("type") & curve("ptype") & (d < 3.5) & (F.abs(F.col("r") - F.col("pr")) < F.greatest(F.lit(1.8), F.lit(0.25) * F.col("r")))
    curves = kernels.greedy(pairs.where(near).select(*by, "gt", "pred", d.alias("d"), (F.col("type") == F.col("ptype")).alias("same")), by, "gt", "pred", ["gt", "d", "pred"], ["same"])
    curves = written(curves, "curves")
    e, pe = F.col("x") + F.col("len"), F.col("px") + F.col("plen")
    close = lambda a, b: F.abs(a - b) < 3
    ends = (close(F.col("x"), F.col("px")) & close(e, pe)) | (close(F.col("x"), pe) & close(e, F.col("px")))
    straight = line("type") & line("ptype") & (F.col("y") == F.col("py")) & ends
    lines = kernels.greedy(pairs.where(straight).select(*by, "gt", "pred"), by, "gt", "pred", ["gt", "pred"])
    fits = (F.col("scope") == "all") & (face % 4 < 2) & (F.col("pface") % 4 < 2) & (F.abs(F.col("v") - F.col("pv")) <= F.greatest(F.lit(0.6), F.lit(0.02) * F.abs("v")))
    rank = F.when(face % 3 == F.col("pface") % 3, -F.col("pred")).otherwise(F.col("pred") + 1_000_000)
    told = {"kind": face % 3, "same": face % 3 == F.col("pface") % 3, "err": F.abs(F.col("v") - F.col("pv"))}
    dims = pairs.where(fits).select("graph", "view", "gt", "pred", rank.alias("rank"), *[c.alias(k) for k, c in told.items()])
    dims = written(kernels.greedy(dims, ["graph", "view"], "gt", "pred", ["gt", "rank"], list(told)), "dims")
    # A dimension refers to its primitive and the next one.
    to = curves.where("scope = 'all'").select("graph", "view", F.col("pred").alias("ref"), F.col("gt").alias("mapped"))
    refs = dims.select("graph", "view", "gt", F.explode(F.array(F.col("pred"), F.col("pred") + 1)).alias("ref")).join(to.hint("merge"), ["graph", "view", "ref"])
    linked = refs.where((F.col("mapped") == F.col("gt")) | (F.col("mapped") == F.col("gt") + 1)).select("graph", "view", "gt").distinct().withColumn("ok", F.lit(True))
    dims = dims.join(linked.hint("merge"), ["graph", "view", "gt"], "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    rate = lambda c: F.round(F.count_if(c) / F.count("*"), 3)
    tenths = F.sum(F.when(F.col("kind") == 0, F.round(F.col("err") * 10).cast("long")))
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    a = curves.groupBy("view", F.lit("curve").alias("part"), "scope").agg(F.count("*").alias("tp"), rate(F.col("same")).alias("type_rate")).select("*", null("double", "diameter_mae"), null("long", "link_ok"), null("long", "link_total"))
    b = lines.groupBy("view", F.lit("line").alias("part"), "scope").agg(F.count("*").alias("tp")).select("*", null("double", "type_rate"), null("double", "diameter_mae"), null("long", "link_ok"), null("long", "link_total"))
    c = dims.groupBy("view", F.lit("dimension").alias("part"), F.lit("all").alias("scope")).agg(F.count("*").alias("tp"), rate(F.col("same")).alias("type_rate"), F.round(tenths / 10 / F.nullif(F.count_if(F.col("kind") == 0), F.lit(0)), 3).alias("diameter_mae"), F.count_if((F.col("kind") < 2) & F.col("ok")).alias("link_ok"), F.count_if(F.col("kind") < 2).alias("link_total"))
    part = F.when(line("type"), "line").otherwise("curve")
    sides = (F.count_if(F.col("role") == "vis").alias("n_gt"), F.count_if(F.col("role") == "hid").alias("n_pred"))
    n = both.groupBy("view", part.alias("part"), "scope").agg(*sides)
    n = n.unionByName(both.where("scope = 'all' and face % 4 < 2").groupBy("view", F.lit("dimension").alias("part"), "scope").agg(*sides))
    j = n.join(a.unionByName(b).unionByName(c), ["view", "part", "scope"], "left").withColumn("tp", F.coalesce("tp", F.lit(0)))
    m = stats.precision_recall(F.col("tp"), F.col("n_pred"), F.col("n_gt"))
    acc = F.round(F.col("link_ok") / F.nullif(F.col("link_total"), F.lit(0)), 3)
    return j.select("view", "part", "scope", "n_gt", "n_pred", "tp", *[v.alias(k) for k, v in m.items()], "type_rate", "diameter_mae", "link_ok", "link_total", acc.alias("link_acc"))


@query("""with d as (select doc_id, coalesce(source, 'none') || '/' || doc_id as id, lang, n_chars from documents), r as (select id || '__clean' as file_name, 'clean' as variant, doc_id, 0 as v, n_chars from d union all select id || '__scan', 'scan', doc_id, 1, n_chars from d where doc_id % 3 > 0),
n as (select *, row_number() over (order by doc_id, v) as n, count(*) over () as total from r), s as (select *, case when n <= greatest(1, floor(total * 0.1::double)) then 'val' else 'train' end as split from n)
select split, variant, count(*) as n, min(n_chars) as min, max(n_chars) as max, (sum(n_chars) // count(*))::bigint as mean from s group by all""")
def variant_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a clean variant each, and some with a scan, written by split in one pass, and what each part holds: the first tenth is for validation."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", F.coalesce("source", F.lit("none")), F.col("doc_id").cast("string")).alias("id"), "n_chars")
    variants = {"clean": F.lit(True), "scan": F.col("doc_id") % 3 > 0}
    done = bundles.variants(d, "id", variants, order=["doc_id"], share=0.1)
    stats_ = bundles.write_bundle(done, bundles.new_folder(spark), F.col("n_chars"))
    return stats_.select("split", "variant", "n", "min", "max", "mean")
