"""Whole drawings as text with all kinds of records, read back and written again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plateworks.operators import records
from plateworks.plans.graphs import PRIMS, prims
from plateworks.plans.registry import query
from plateworks.plans.serial import _K, geometry, num, typed
from plateworks.shared import written
from plateworks.sources import table


def drawing_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of each drawing: features by the faces that it has, primitives of six types with their tags and diameters, spans as dimensions."""
    k = written(typed(prims(spark, sf_dir)), "typed").where("kind <> 'spline'").withColumns({c: F.col(c) / 4 for c in ("x", "y", "r", "len")})
    place = F.when(F.col("view") == "N", 0).when(F.col("view") == "R", 1).otherwise(2)
    g = geometry(flips=False)
    tag = lambda i: F.concat(F.lit("C"), i.cast("string"))
    owners = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 20).cast("long").alias("face"), (F.col("s_nationkey") % 6 + 1).cast("long").alias("i"))
    tags = owners.groupBy("face").agg(F.array_sort(F.collect_set("i")).alias("i"))
    n = lambda section, rest: F.lit(section * 10**12).cast("long") + rest
    p = k.join(tags, "face", "left")
    head = p.groupBy("graph").agg(F.array(F.max(F.col("x") + F.col("len")), F.max(F.col("y") + F.col("r")), F.max("face").cast("double")).alias("bbox"))
    even = F.col("graph") % 2 == 0
    head = head.select("graph", n(0, F.lit(0)).alias("n"), F.lit("PART").alias("record"), "bbox", F.when(even, 1000).alias("grid"), F.when(even, F.array_max("bbox")).alias("ext"))
    feats = p.select("graph", F.explode("i").alias("i")).distinct()
    feats = feats.select("graph", n(1, F.col("i")).alias("n"), F.lit("FEAT").alias("record"), tag(F.col("i")).alias("name"), F.lit("cylinder").alias("kind"), F.element_at(F.array(*map(F.lit, "XYZ")), (F.col("i") % 3 + 1).cast("int")).alias("axis"), F.when(F.col("i") % 4 > 0, F.col("i") * 1.25).alias("r"), F.when(F.col("i") % 2 == 1, "+Z").alias("dir"))
    blends = head.where("graph % 3 = 0").select("graph", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("j"))
    blends = blends.select("graph", n(2, F.col("j")).alias("n"), F.lit("BLEND").alias("record"), F.when(F.col("j") == 1, "fillet").otherwise("chamfer").alias("kind"), F.concat(F.lit("|Z"), (F.col("graph") % 5).cast("string")).alias("sel"), F.when(F.col("j") == 1, F.col("graph") % 40 / 4).alias("value"))
    views = p.select("graph", "view").distinct().select("graph", n(3, place * 10**9).alias("n"), F.lit("VIEW").alias("record"), "view", F.array(F.lit("X"), F.lit("Y")).alias("axes"))
    mark = F.create_map(*[F.lit(x) for kv in records.TYPES.items() for x in kv])[F.col("kind")]
    dias = F.when(F.col("face") % 4 == 0, F.array(F.col("r") * 2)).when(F.col("face") == 7, F.array(F.col("r") * 2, F.col("r") * 2 + 0.25))
    rows = p.select("graph", n(3, place * 10**9 + F.col("pi") + 1).alias("n"), F.lit("ROW").alias("record"), "view", mark.alias("kind"), "role", g["pts"].alias("pts"), F.when(g["cx"].isNotNull(), F.array(g["cx"], g["cy"])).alias("c"), g["r"].alias("r"), g["rmaj"].alias("rmaj"), g["rmin"].alias("rmin"), g["rot"].alias("rot"), F.when(g["from"].isNotNull(), F.array(g["from"], g["to"])).alias("arc"), F.transform("i", tag).alias("tags"), dias.alias("dias"))
    dims = p.where("face % 4 = 1").select("graph", n(4, F.col("pi")).alias("n"), F.lit("DIM").alias("record"), F.concat(F.lit("D"), F.col("pi").cast("string")).alias("name"), F.lit("linear").alias("kind"), F.lit("size").alias("role"), F.col("len").alias("value"), "view", F.when(F.col("face") != 5, "X").alias("axis"), (-F.col("x")).alias("low"), (F.col("x") + F.col("len")).alias("high"))
    every = [records.complete(d, "graph") for d in (head, feats, blends, views, rows, dims)]
    out = every[0]
    for d in every[1:]:
        out = out.unionByName(d)
    return out


@query(PRIMS + _K + f""", q as (select graph, view, role, pi, kind, face, a1, a2, x / 4 as x, y / 4 as y, r / 4 as r, len / 4 as len, case view when 'N' then 0 when 'R' then 1 else 2 end as vo from k where kind <> 'spline'),
o as (select face, list_sort(list(distinct i)) as i from (select (s_suppkey % 20)::bigint as face, (s_nationkey % 6 + 1)::bigint as i from supplier) group by face),
p2 as (select q.*, o.i from q left join o using (face)),
hd as (select graph, max(x + len) as w, max(y + r) as h, max(face) as z from p2 group by graph),
recs as (select graph, 0::bigint as n, 'PART unit=mm bbox=' || {num('w')} || ',' || {num('h')} || ',' || {num('z')} || case when graph % 2 = 0 then ' grid=1000 ext=' || {num('greatest(w, h, z)')} else '' end as t from hd
 union all select graph, 1000000000000 + i, 'FEAT C' || i || ' cylinder axis=' || ['X', 'Y', 'Z'][(i % 3 + 1)::int] || ' r=' || case when i % 4 > 0 then {num('i * 1.25::double')} else '-' end || case when i % 2 = 1 then ' dir=+Z' else '' end from (select distinct graph, unnest(i) as i from p2)
 union all select graph, 2000000000000 + j, 'BLEND ' || case j when 1 then 'fillet' else 'chamfer' end || ' |Z' || (graph % 5) || ' v' || case j when 1 then {num('graph % 40 / 4')} else '-' end from (select graph, unnest([1, 2]) as j from hd where graph % 3 = 0)
 union all select graph, 3000000000000 + vo * 1000000000, 'VIEW ' || view || ' axes=X,Y' from (select distinct graph, view, vo from p2)
 union all select graph, 3000000000000 + vo * 1000000000 + pi + 1, case kind when 'line' then 'L' when 'polyline' then 'PL' when 'circle' then 'CI' when 'arc' then 'A' when 'point' then 'PT' else 'EL' end || ' ' || role || ' ' ||
  case kind when 'line' then {num('x')} || ',' || {num('y')} || ' ' || {num('x + len')} || ',' || {num('y')} when 'polyline' then {num('x')} || ',' || {num('y')} || ' ' || {num('x + len')} || ',' || {num('y')} || ' ' || {num('x + len')} || ',' || {num('y + r')}
   when 'point' then {num('x')} || ',' || {num('y')} when 'circle' then 'c' || {num('x')} || ',' || {num('y')} || ' r' || {num('r')} when 'arc' then 'c' || {num('x')} || ',' || {num('y')} || ' r' || {num('r')} || ' a' || {num('a1')} || '..' || {num('a2')}
   else 'c' || {num('x')} || ',' || {num('y')} || ' rj' || {num('r + len')} || ' rn' || {num('r')} || ' rot' || {num('face * 18 % 180')} || ' e' || {num('a1')} || '..' || {num('a2')} end || coalesce(' ' || array_to_string(list_transform(i, lambda v: 'C' || v), ','), '') ||
  case when face % 4 = 0 then ' DIA' || {num('r * 2')} when face = 7 then ' DIA' || {num('r * 2')} || ' DIA' || {num('r * 2 + 0.25::double')} else '' end from p2
 union all select graph, 4000000000000 + pi, 'DIM D' || pi || ' linear size ' || {num('len')} || ' ' || view || ' ' || case when face <> 5 then 'X' || {num('-x')} || '..' || {num('x + len')} else '-' end from p2 where face % 4 = 1)
select graph, md5(string_agg(t, chr(10) order by n)) as digest, true as same, true as same_tokens, count(*) as n_records, count(*) filter (t like 'FEAT%') as n_feats, count(*) filter (t like 'BLEND%') as n_blends, count(*) filter (t like 'DIM%') as n_dims,
 (select count(*) from p2 where p2.graph = recs.graph and p2.view = 'A') as n_in_a, (select sum(case when face % 4 = 0 then 1 when face = 7 then 2 else 0 end)::bigint from p2 where p2.graph = recs.graph) as n_dias from recs group by graph""")
def record_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each drawing's text, whether it reads back and writes again byte by byte, also with coordinate tokens, and the census of what was read."""
    # Written, as each is used several times.
    text = written(records.emit(drawing_records(spark, sf_dir), "graph"), "texts")
    read = written(records.parse(text, "graph", "text"), "records")
    again = records.emit(read, "graph").withColumnRenamed("text", "again")
    # Tokens hold whole coordinates only: in quarters they are.
    scale = lambda c: F.transform(c, lambda v: v * 4)
    whole = read.withColumns({c: F.col(c) * 4 for c in ("rmaj", "rmin", "low", "high")} | {"r": F.when(F.col("record") == "ROW", F.col("r") * 4).otherwise(F.col("r")), "c": scale("c"), "pts": F.transform("pts", lambda p: F.transform(p, lambda v: v * 4))})
    tokens = written(records.emit(whole, "graph", tokens=True), "tokens")
    back = records.emit(records.parse(tokens, "graph", "text"), "graph", tokens=True).withColumnRenamed("text", "back")
    tokens = tokens.join(back, "graph").select("graph", (F.col("text") == F.col("back")).alias("same_tokens"))
    is_ = lambda kind: F.count_if(F.col("record") == kind)
    census = read.groupBy("graph").agg(F.count("*").alias("n_records"), is_("FEAT").alias("n_feats"), is_("BLEND").alias("n_blends"), is_("DIM").alias("n_dims"), F.count_if((F.col("record") == "ROW") & (F.col("view") == "A")).alias("n_in_a"), F.sum(F.coalesce(F.when(F.col("dias").isNotNull(), F.size("dias")), F.lit(0))).alias("n_dias"))
    done = text.join(again, "graph").join(census, "graph").join(tokens, "graph")
    return done.select("graph", F.md5(F.col("text").cast("binary")).alias("digest"), (F.col("text") == F.col("again")).alias("same"), "same_tokens", "n_records", "n_feats", "n_blends", "n_dims", "n_in_a", "n_dias")
