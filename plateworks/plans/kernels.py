"""Queries of the order-dependent kernels; their results are tested against plain Python."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plateworks.operators import kernels, stats
from plateworks.plans.graphs import PRIMS, prims
from plateworks.plans.registry import query
from plateworks.sources import table


_PAIRS = PRIMS + """, t as (select graph, view, pi as gt, x, y, r, len from p where role = 'vis'), q as (select graph, view, pi as pred, x as px, y as py, r as pr, len as pl from p where role = 'hid'),
c as (select *, sqrt((x - px) * (x - px) + (y - py) * (y - py)) as d from t join q using (graph, view)),
l as (select graph, view, list([struct_pack(g := gt, p := pred)] order by {order}) as c from c where {fits} group by all),
k as (select view, len(list_reduce(c, lambda a, e: case when list_bool_or(list_transform(a, lambda k: k.g = e[1].g or k.p = e[1].p)) then a else a || e end)) as n from l),
s as (select view, n_gt, n_pred, coalesce(tp, 0)::bigint as tp from (select view, count(*) as n_gt from t group by view) join (select view, count(*) as n_pred from q group by view) using (view) left join (select view, sum(n)::bigint as tp from k group by view) using (view))
select *, round(tp / n_pred, 3) as precision, round(tp / n_gt, 3) as recall, round(case when tp > 0 then 2 * (tp / n_pred) * (tp / n_gt) / (tp / n_pred + tp / n_gt) else 0 end, 3) as f1 from s"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = prims(spark, sf_dir)
    truth = p.where("role = 'vis'").select("graph", "view", F.col("pi").alias("gt"), "x", "y", "r", "len")
    pred = p.where("role = 'hid'").select("graph", "view", F.col("pi").alias("pred"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("r").alias("pr"), F.col("len").alias("pl"))
    return truth, pred


@query(_PAIRS.format(order="gt, d, pred", fits="d < 3.5 and abs(r - pr) < greatest(1.8::double, 0.25::double * r)"))
def greedy_curve_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truths in order take the nearest unused prediction within 3.5 and a radius within max(1.8, 25%); counts and rates by view."""
    truth, pred = _sides(spark, sf_dir)
    d = F.sqrt((F.col("x") - F.col("px")) * (F.col("x") - F.col("px")) + (F.col("y") - F.col("py")) * (F.col("y") - F.col("py")))
    near = truth.join(pred, ["graph", "view"]).withColumn("d", d).where((F.col("d") < 3.5) & (F.abs(F.col("r") - F.col("pr")) < F.greatest(F.lit(1.8), F.lit(0.25) * F.col("r"))))
    pairs = kernels.greedy(near.select("graph", "view", "gt", "pred", "d"), ["graph", "view"], "gt", "pred", ["gt", "d", "pred"])
    return _rates(truth, pred, pairs)


def _rates(truth: DataFrame, pred: DataFrame, pairs: DataFrame) -> DataFrame:
    n = lambda df, name: df.groupBy("view").agg(F.count("*").alias(name))
    c = n(truth, "n_gt").join(n(pred, "n_pred"), "view").join(n(pairs, "tp"), "view", "left").withColumn("tp", F.coalesce("tp", F.lit(0)))
    m = stats.precision_recall(F.col("tp"), F.col("n_pred"), F.col("n_gt"))
    return c.select("view", "n_gt", "n_pred", "tp", *[v.alias(k) for k, v in m.items()])


@query(_PAIRS.format(order="gt, pred", fits="y = py and ((abs(x - px) < 3 and abs(x + len - px - pl) < 3) or (abs(x - px - pl) < 3 and abs(x + len - px) < 3))"))
def greedy_line_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truths in order take the first unused prediction both of whose ends are near, in either direction."""
    truth, pred = _sides(spark, sf_dir)
    e, pe = F.col("x") + F.col("len"), F.col("px") + F.col("pl")
    same_y = F.col("y") == F.col("py")
    near = same_y & (((F.abs(F.col("x") - F.col("px")) < 3) & (F.abs(e - pe) < 3)) | ((F.abs(F.col("x") - pe) < 3) & (F.abs(e - F.col("px")) < 3)))
    pairs = kernels.greedy(truth.join(pred, ["graph", "view"]).where(near).select("graph", "view", "gt", "pred"), ["graph", "view"], "gt", "pred", ["gt", "pred"])
    return _rates(truth, pred, pairs)


@query(_PAIRS.format(order="gt, case when y = py then -pred else pred + 1000000 end", fits="abs(x - px) <= greatest(0.6::double, 0.02::double * abs(x))"))
def greedy_dim_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truths in order by value within max(0.6, 2%): the last unused one of the same kind, else the first that fits."""
    truth, pred = _sides(spark, sf_dir)
    fits = F.abs(F.col("x") - F.col("px")) <= F.greatest(F.lit(0.6), F.lit(0.02) * F.abs("x"))
    same = F.col("y") == F.col("py")
    near = truth.join(pred, ["graph", "view"]).where(fits).withColumn("rank", F.when(same, -F.col("pred")).otherwise(F.col("pred") + 1_000_000))
    pairs = kernels.greedy(near.select("graph", "view", "gt", "pred", "rank"), ["graph", "view"], "gt", "pred", ["gt", "rank"])
    return _rates(truth, pred, pairs)


@query(_PAIRS.format(order="-pl, pred, d, gt", fits="d < greatest(8.0::double, 0.3::double * r) and abs(r - pr) <= 0.35::double * r"))
def detection_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections by score take the nearest unused truth within max(8, 30%) of its radius."""
    truth, pred = _sides(spark, sf_dir)
    d = F.sqrt((F.col("x") - F.col("px")) * (F.col("x") - F.col("px")) + (F.col("y") - F.col("py")) * (F.col("y") - F.col("py")))
    near = truth.join(pred, ["graph", "view"]).withColumn("d", d).where((F.col("d") < F.greatest(F.lit(8.0), F.lit(0.3) * F.col("r"))) & (F.abs(F.col("r") - F.col("pr")) <= F.lit(0.35) * F.col("r")))
    near = near.withColumn("score", -F.col("pl"))
    pairs = kernels.greedy(near.select("graph", "view", "gt", "pred", "score", "d"), ["graph", "view"], "pred", "gt", ["score", "pred", "d", "gt"])
    return _rates(truth, pred, pairs)


def _close(kept: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.hypot(kept[:, 0] - p[0], kept[:, 1] - p[1]) < 0.6 * np.maximum(kept[:, 2], p[2])


@query(PRIMS + """, l as (select graph, view, list([struct_pack(pi := pi, x := x, y := y, r := r)] order by -r, pi) as c from p group by all),
k as (select graph, view, unnest(list_reduce(c, lambda a, e: case when list_bool_or(list_transform(a, lambda k: 25 * ((k.x - e[1].x) * (k.x - e[1].x) + (k.y - e[1].y) * (k.y - e[1].y)) < 9 * greatest(k.r, e[1].r) * greatest(k.r, e[1].r))) then a else a || e end)) as e from l)
select graph, view, e.pi as pi, e.r as r from k""")
def suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Circles kept by falling radius where none kept is near."""
    p = prims(spark, sf_dir).select("graph", "view", "pi", "x", "y", "r").withColumn("score", -F.col("r"))
    kept = kernels.suppressed(p, ["graph", "view"], ["score", "pi"], _close, ["x", "y", "r"])
    return kept.select("graph", "view", "pi", "r")


@query("""with l as (select source, lang, list([struct_pack(id := doc_id, n := 1, len := n_chars, b := 0::bigint)] order by n_chars nulls first, doc_id) as c from documents group by all),
k as (select source, lang, unnest(list_reduce(c, lambda a, e: a || [case when a[-1].n + 1 > 16 or e[1].len * (a[-1].n + 1) > 60000 then struct_pack(id := e[1].id, n := 1, len := e[1].len, b := a[-1].b + 1) else struct_pack(id := e[1].id, n := a[-1].n + 1, len := e[1].len, b := a[-1].b) end])) as e from l)
select e.id as doc_id, source, lang, e.len as n_chars, e.b as batch from k""")
def token_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of at most 16 documents and 60,000 padded characters, by source and language."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    return kernels.token_batches(d, ["source", "lang"], "n_chars", "doc_id", 16, 60_000)


@query()
def kshot_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three examples of each source at even ranks of length under a budget."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return kernels.picks(d, ["source"], "n_chars", "doc_id", 3, 20_000)


@query(r"""select p_partkey, case when t = '-0' then '0' else t end as text, r::double as rounded, t::double = r::double as same
from (select p_partkey, r, regexp_replace(r, '\.?0+$', '') as t from (select p_partkey, printf('%.2f', p_retailprice / 8) as r from part))""")
def number_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices as canonical numbers and as they read back."""
    t = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") / 8).alias("v"))
    return t.select("p_partkey", kernels.canonical_number("v").alias("text"), kernels.exact_round("v").alias("rounded")).withColumn("same", F.col("text").cast("double") == F.col("rounded"))


@query(PRIMS + """select graph, pi, '{"v":"' || view || '",' || case when role = 'vis' then '"s":1,' else '' end || '"c":[' || x || ',' || y || '],"r":' || r || '}' as text, true as same from p""")
def compact_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as short-keyed JSON and read back; nulls are left out."""
    p = prims(spark, sf_dir).select("graph", "pi", F.struct(F.col("view").alias("v"), F.when(F.col("role") == "vis", 1).alias("s"), F.array("x", "y").alias("c"), "r").alias("o"))
    t = p.withColumn("text", F.to_json("o"))
    back = F.from_json("text", "v string, s int, c array<bigint>, r bigint")
    return t.select("graph", "pi", "text", (F.to_json(back) == F.col("text")).alias("same"))


@query()
def json_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON of each drawing, cut off at a place that depends on it, and what can be saved."""
    p = prims(spark, sf_dir)
    g = p.groupBy("graph").agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct("pi", "x", "r"))).alias("p"))).alias("t"))
    cut = F.substring("t", F.lit(1), F.when(F.col("graph") % 4 == 0, F.length("t")).otherwise((F.length("t") * (F.col("graph") % 10) / 10).cast("int")))
    r = g.select("graph", kernels.repair_json(cut).alias("r"))
    return r.select("graph", "r.status", F.size(F.from_json("r.body", "p array<struct<pi:bigint,x:bigint,r:bigint>>")["p"]).alias("n_kept"))


@query()
def strip_blends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs written from parts, with a blend at the end, in the middle, behind selectors, or none, and with an error."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    size = F.col("p_size").cast("string")
    box = F.concat(F.lit('r = cq.Workplane("XY").box('), size, F.lit(", 2, 3)"))
    tail = F.when(k % 5 == 0, '.edges("|Z").fillet(0.5)').when(k % 5 == 1, ".faces().edges().first().chamfer(0.2).translate((1, 0, 0))").when(k % 5 == 2, "").when(k % 5 == 3, ".fillet(").otherwise(".hole(1)")
    t = p.select("p_partkey", F.concat(box, tail, F.lit("\n")).alias("source"))
    r = t.select("p_partkey", "source", kernels.stripped("source").alias("s"))
    return r.select("p_partkey", "s.code", "s.n", "s.error", (F.col("s.code") == F.col("source")).alias("unchanged"))
