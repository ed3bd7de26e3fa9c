"""What detectors and tiles leave open: recovered circles, merged tiles, solved constraints, dropout of what other views show.

On the primitives of plans.graphs: hidden ones stand for detections, visible ones for truth, and a view for a tile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plateworks.operators import drawing, kernels, recovery, solve, tiles
from plateworks.plans.graphs import PRIMS, prims
from plateworks.plans.registry import query
from plateworks.shared import written
from plateworks.sources import table


@query(PRIMS + """, d as (select graph, x * 6.0::double as x, y * 12.0::double as y, r * 5.0::double as r from p where role = 'hid'),
a as (select graph, pi as no, x * 6.0::double as x, y * 12.0::double as y, (2 * r + face % 2)::double as value from p where role = 'vis' and face % 4 < 2),
s as (select graph, median(vote) as scale from (select a.graph, a.no, min(d.r) / (any_value(a.value) / 2) as vote from a join d on d.graph = a.graph and sqrt((d.x - a.x) * (d.x - a.x) + (d.y - a.y) * (d.y - a.y)) < 15 group by all) group by graph),
m as (select a.graph, a.no, a.x, a.y, value / 2 * scale as r from a join s using (graph) where value / 2 * scale between 3 and 600
 and not exists (select 1 from d where d.graph = a.graph and sqrt((d.x - a.x) * (d.x - a.x) + (d.y - a.y) * (d.y - a.y)) < greatest(10, 0.4::double * greatest(a.value / 2 * s.scale, d.r)))),
l as (select graph, list([struct_pack(no := no, x := x, y := y, r := r)] order by no) as c from m group by graph),
k as (select graph, unnest(list_reduce(c, lambda a, e: case when list_bool_or(list_transform(a, lambda k: sqrt((k.x - e[1].x) * (k.x - e[1].x) + (k.y - e[1].y) * (k.y - e[1].y)) < greatest(10, 0.4::double * greatest(k.r, e[1].r)))) then a else a || e end)) as e from l)
select graph, e.no as no, e.x as x, e.y as y, round(e.r, 6) as r from k""")
def anchor_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Circles that a diameter is written for and that no detection stands for, at the scale that the other diameters of the drawing give."""
    p = written(prims(spark, sf_dir), "prims").withColumns({"x": F.col("x") * 6.0, "y": F.col("y") * 12.0})
    detections = p.where("role = 'hid'").select("graph", "x", "y", (F.col("r") * 5.0).alias("r"))
    anchors = p.where("role = 'vis' and face % 4 < 2").select("graph", F.col("pi").alias("no"), "x", "y", (2 * F.col("r") + F.col("face") % 2).cast("double").alias("value"))
    return recovery.recovered(detections, anchors, "graph").withColumn("r", F.round("r", 6))


_TILES = PRIMS + """, q as (select graph, case view when 'A' then 0 when 'N' then 1 else 2 end as tile, pi as ord, pi as id, case when pi % 3 = 0 then 'circle' else 'line' end as type,
  (x * 4 + (pi % 2) * len * (case when pi % 3 = 0 then 0 else 5 end))::double as x1, (y * 9)::double as y1, (x * 4 + ((pi + 1) % 2) * len * 5)::double as x2, (y * 9 + r)::double as y2, (r * 5)::double as r, len, role, face from p),
t as (select *, case when type = 'line' then x2 else x1 end as cx, case when type = 'line' then y2 else y1 end as cy from q),
l as (select graph, list([struct_pack(id := id, type := type, x1 := x1, y1 := y1, x2 := cx, y2 := cy, r := r)] order by tile, ord) as c from t group by graph),
k as (select graph, list_reduce(c, lambda a, e: case when list_bool_or(list_transform(a, lambda k: {same})) then a else a || e end) as kept from l),
m as (select t.*, list_filter(kept, lambda k: {mine})[1].id as stands from t join k using (graph))
"""


def _near(k: str, e: str) -> str:
    far = lambda i, j: f"sqrt(({k}.x{i} - {e}.x{j}) * ({k}.x{i} - {e}.x{j}) + ({k}.y{i} - {e}.y{j}) * ({k}.y{i} - {e}.y{j})) < 20"
    return f"{k}.type = {e}.type and case when {k}.type = 'line' then ({far(1, 1)} and {far(2, 2)}) or ({far(1, 2)} and {far(2, 1)}) else {far(1, 1)} and abs({k}.r - {e}.r) < greatest(8, 0.2::double * {k}.r) end"


_MERGED = _TILES.format(same=_near("k", "e[1]"), mine=_near("k", "t").replace("t.x2", "t.cx").replace("t.y2", "t.cy"))


@query(_MERGED + """, d as (select *, list_sort(list_distinct(list_filter([stands, other], lambda x: x is not null))) as refs from (select m.*, o.stands as other from m left join m o on o.graph = m.graph and o.tile = m.tile and o.id = m.id + 1 where m.face % 2 = 1)),
f as (select graph, role as kind, len / 10.0 as value, refs, min(tile * 1000000 + ord) as first, count(*) as n_merged from d group by all)
select graph, row_number() over (partition by graph order by first) as no, kind, value::double as value, array_to_string(refs, ',') as refs, n_merged from f""")
def tile_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations of merged tiles, with references to the lines and circles that stay; equal kind, value and set of references are one."""
    p = written(prims(spark, sf_dir), "prims")
    line = F.col("pi") % 3 != 0
    tile = F.when(F.col("view") == "A", 0).when(F.col("view") == "N", 1).otherwise(2)
    n, x, odd = F.col("len"), F.col("x") * 4, F.col("pi") % 2
    q = p.select(
        "graph", tile.alias("tile"), F.col("pi").alias("ord"), F.col("pi").alias("id"), F.when(line, "line").otherwise("circle").alias("type"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), "len", "role", "face",
        (x + odd * n * F.when(line, 5).otherwise(0)).cast("double").alias("x1"), (F.col("y") * 9).cast("double").alias("y1"), (x + (1 - odd) * n * 5).cast("double").alias("x2"), (F.col("y") * 9 + F.col("r")).cast("double").alias("y2"), (F.col("r") * 5).cast("double").alias("r"),
    )
    merged = tiles.merged(tiles.shifted(q), "graph")
    dims = q.where("face % 2 = 1").select("graph", "tile", "ord", F.col("role").alias("kind"), (n / 10).alias("value"), F.array("id", F.col("id") + 1).alias("refs"))
    named = lambda refs: F.array_join(F.transform(F.array_sort(F.array_distinct(F.transform(refs, lambda r: r["id"]))), lambda r: r.cast("string")), ",")
    return tiles.remapped(dims, merged, "graph").select("graph", "no", "kind", "value", named("refs").alias("refs"), "n_merged")


@query("""with p as (select p_partkey as k, 10 + p_size as w, 20 + p_partkey % 90 as h, 5 + p_size % 7 as r from part)
select k as part, case when k % 13 = 0 then 'unmet' when k % 11 = 0 then 'free' else 'solved' end as status, case when k % 11 = 0 then 10 else 11 end::int as rank,
 case when k % 13 > 0 then w::double end as x2, case when k % 13 > 0 then h::double end as y2, case when k % 13 > 0 then w / 2.0::double end as cx, case when k % 13 > 0 then h / 2.0::double end as cy,
 case when k % 13 > 0 then case when k % 11 = 0 then r + ((k * 7919 + 10 * 104729) % 17 - 8) / 2.0::double else r::double end end as r from p""")
def constraint_solve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners of a plate, centre and radius of its bore, from a distorted seed and the plate's constraints; every other plate has a diagonal for its height.

    Every 11th lacks the bore's diameter, which stays as it was, and every 13th has a width too much.
    """
    k, w, h, r = F.col("k"), F.col("w"), F.col("h"), F.col("r")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), (10.0 + F.col("p_size")).alias("w"), (20.0 + F.col("p_partkey") % 90).alias("h"), (5.0 + F.col("p_size") % 7).alias("r"))
    zero = F.lit(0.0)
    true = [zero, zero, w, zero, w, h, zero, h, w / 2, h / 2, r]
    seed = F.array(*[v + ((k * 7919 + i * 104729) % 17 - 8) / 2 for i, v in enumerate(true)])

    def c(kind: str, value: Column, *at: int) -> Column:
        places = [F.lit(x).cast("int") for x in at] + [F.lit(None).cast("int")] * (4 - len(at))
        return F.struct(F.lit(kind).alias("kind"), *[x.alias(n) for x, n in zip(places, "abcd", strict=True)], value.alias("value"))

    height = F.when(k % 2 == 0, c("gap", h, 1, 7)).otherwise(c("distance", F.sqrt(w * w + h * h), 0, 1, 4, 5))
    always = [c("fix", zero, 0), c("fix", zero, 1), c("gap", zero, 1, 3), c("gap", zero, 7, 5), c("gap", zero, 0, 6), c("gap", zero, 2, 4), c("gap", w, 0, 2), height, c("middle", zero, 0, 2, 8), c("middle", zero, 1, 7, 9)]
    all_ = F.array(*always)
    all_ = F.when(k % 11 != 0, F.array_append(all_, c("fix", r, 10))).otherwise(all_)
    all_ = F.when(k % 13 == 0, F.array_append(all_, c("fix", w + 3, 2))).otherwise(all_)
    # A part is a few bytes in the table but takes about a millisecond here, so parts are dealt out first: files alone would give few tasks.
    p = p.repartition(4 * spark.sparkContext.defaultParallelism, "k")
    s = solve.solve(p.select("k", seed.alias("seed"), all_.cast(f"array<{solve.CONSTRAINT}>").alias("constraints")))
    at = lambda i: F.when(F.col("solution.status") != "unmet", F.round(F.col("solution.values")[i], 6) + 0.0)
    return s.select(F.col("k").alias("part"), "solution.status", "solution.rank", at(4).alias("x2"), at(5).alias("y2"), at(8).alias("cx"), at(9).alias("cy"), at(10).alias("r"))


@query(PRIMS + """, ff as (select distinct (s_suppkey % 20)::bigint as face, 'cyl' || (s_nationkey % 6) as tag from supplier), t as (select graph, view, role, pi, tag from p join ff using (face)),
seen as (select distinct graph, tag, view from t where role = 'vis'),
e as (select t.graph, t.pi, bool_and(exists (select 1 from seen s where s.graph = t.graph and s.tag = t.tag) and not exists (select 1 from seen s where s.graph = t.graph and s.tag = t.tag and s.view = t.view)) as able from t where role = 'hid' group by all)
select graph, pi, ('0x' || left(md5('7:' || graph || '/' || pi), 8))::bigint < 1288490189 as is_dropped from e where able""")
def hidden_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hidden rows all of whose tags are visible in another view and not in this one, dropped with a share of 0.3 by a seeded hash."""
    faces = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 20).cast("long").alias("face"), F.concat(F.lit("cyl"), (F.col("s_nationkey") % 6).cast("string")).alias("tag"))
    tags = faces.groupBy("face").agg(F.collect_set("tag").alias("tags"))
    # Faces are numbered modulo 20, so their tags are few rows of few names, whatever the number of suppliers.
    p = prims(spark, sf_dir).select("graph", "view", "role", "pi", "face").join(F.broadcast(tags), "face", "left")
    able = drawing.shown_elsewhere(p, "graph", "view", "pi", "tags", F.col("role") == "hid", F.col("role").isin("vis", "vh"))
    return able.select("graph", "pi", kernels.dropped_out(F.concat_ws("/", "graph", "pi"), 7, 0.3).alias("is_dropped"))
