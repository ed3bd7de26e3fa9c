"""Results of stages brought together: precedence, defaults, reports of matches, checks of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plateworks.operators import kernels, stats
from plateworks.plans.graphs import PRIMS, prims
from plateworks.plans.registry import SQL, query
from plateworks.plans.serial import serialised
from plateworks.shared import written
from plateworks.sources import table


@query("""with x as (select l_orderkey, bool_and(l_linestatus = 'F') as ok, min(l_returnflag) as l_returnflag from lineitem where l_linenumber = 1 and l_returnflag <> 'N' group by l_orderkey)
select o_orderkey, coalesce(case when o_custkey % 13 = 0 then 'serialize_error' when o_custkey % 17 = 0 then 'oom' when x.l_orderkey is not null then case when x.ok then 'ok' else 'error_' || x.l_returnflag end end, 'crash_no_result') as error_type,
 not (o_custkey % 13 = 0 or o_custkey % 17 = 0) as gen, case when not (o_custkey % 13 = 0 or o_custkey % 17 = 0) then coalesce(x.ok, false) end as exec_ok from orders left join x on x.l_orderkey = o_orderkey""")
def result_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each input: its error of serialisation before its failure of generation, before what ran, before a crash."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    unread = o.where("o_custkey % 13 = 0").select("o_orderkey", F.lit("serialize_error").alias("unread"))
    failed = o.where("o_custkey % 17 = 0").select("o_orderkey", F.lit("oom").alias("failed"))
    ran = table(spark, sf_dir, "lineitem").where("l_linenumber = 1 and l_returnflag <> 'N'").groupBy(F.col("l_orderkey").alias("o_orderkey"))
    ran = ran.agg(F.bool_and(F.col("l_linestatus") == "F").alias("ok"), F.min("l_returnflag").alias("flag"))
    ran = ran.select("o_orderkey", "ok", F.when(F.col("ok"), "ok").otherwise(F.concat(F.lit("error_"), F.col("flag"))).alias("ran"))
    r = o.join(unread, "o_orderkey", "left").join(failed, "o_orderkey", "left").join(ran, "o_orderkey", "left")
    gen = F.col("unread").isNull() & F.col("failed").isNull()
    return r.select("o_orderkey", F.coalesce("unread", "failed", "ran", F.lit("crash_no_result")).alias("error_type"), gen.alias("gen"), F.when(gen, F.coalesce("ok", F.lit(False))).alias("exec_ok"))


@query("select doc_id, n_chars, coalesce(quality, -1)::int as quality, coalesce(toxic, 0)::int as toxic, labels.doc_id is not null as has_row from documents left join labels using (doc_id)".replace("labels.doc_id is not null", "quality is not null"))
def execution_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was generated beside what was executed, by id, with defaults."""
    x = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(x, "doc_id", "left")
    default = lambda c, v: F.coalesce(F.col(c), F.lit(v)).cast("int").alias(c)
    return d.select("doc_id", "n_chars", default("quality", -1), default("toxic", 0), F.col("quality").isNotNull().alias("has_row"))


@query(PRIMS + """, g as (select *, row_number() over (partition by graph, view, x, y order by pi) as n from p where role = 'vis'), h as (select *, row_number() over (partition by graph, view, x, y order by pi) as n from p where role = 'hid'),
pairs as (select g.graph, g.view, g.pi as gt, h.pi as pred, g.face % 2 = h.face % 2 as same_type from g join h using (graph, view, x, y, n)),
gd as (select graph, view, pi, r * 2 as value, face % 3 as kind, row_number() over (partition by graph, view, r order by pi) as n from p where role = 'vis' and face % 4 < 2), hd as (select graph, view, pi, r * 2 as value, face % 3 as kind, row_number() over (partition by graph, view, r order by pi) as n from p where role = 'hid' and face % 4 < 2),
dims as (select gd.graph, gd.view, gd.pi as gt, hd.pi as pred, gd.kind, gd.kind = hd.kind as same_kind from gd join hd using (graph, view, value, n)),
linked as (select dims.*, coalesce(pairs.gt = dims.gt, false) as ok from dims left join pairs on pairs.graph = dims.graph and pairs.view = dims.view and pairs.pred = dims.pred),
a as (select view, count(*) as n_curves, round(count(*) filter (same_type) / count(*), 3) as type_agree_rate from pairs group by view),
b as (select view, count(*) as n_dims, round(count(*) filter (same_kind) / count(*), 3) as type_acc, count(*) filter (kind < 2) as link_total, count(*) filter (kind < 2 and ok) as link_ok from linked group by view)
select view, n_curves, type_agree_rate, n_dims, type_acc, link_total, link_ok, round(link_ok / nullif(link_total, 0), 3) as link_acc from a full join b using (view)""")
def score_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of types over matched curves, of kinds over matched dimensions, and whether the references of a dimension, mapped through the curves, are those of its truth."""
    p = written(prims(spark, sf_dir), "prims").select("graph", "view", "role", "pi", "x", "y", "r", "face")

    def side(role: str, by: list[str], name: str, *more: str) -> DataFrame:
        n = F.row_number().over(Window.partitionBy("graph", "view", *by).orderBy("pi"))
        d = p.where(F.col("role") == role).where("face % 4 < 2") if name == "dims" else p.where(F.col("role") == role)
        return d.select("graph", "view", *by, n.alias("n"), F.col("pi").alias("gt" if role == "vis" else "pred"), (F.col("face") % (3 if name == "dims" else 2)).alias(f"t_{role}"))

    pair = lambda by, name: side("vis", by, name).join(side("hid", by, name), ["graph", "view", *by, "n"])
    pairs, dims = pair(["x", "y"], "curves"), pair(["r"], "dims")
    through = pairs.select("graph", "view", "pred", F.col("gt").alias("mapped"))
    linked = dims.join(through, ["graph", "view", "pred"], "left").withColumn("ok", F.coalesce(F.col("mapped") == F.col("gt"), F.lit(False)))
    same, asked = F.col("t_vis") == F.col("t_hid"), F.col("t_vis") < 2
    rate = lambda c: F.round(F.count_if(c) / F.count("*"), 3)
    a = pairs.groupBy("view").agg(F.count("*").alias("n_curves"), rate(same).alias("type_agree_rate"))
    b = linked.groupBy("view").agg(F.count("*").alias("n_dims"), rate(same).alias("type_acc"), F.count_if(asked).alias("link_total"), F.count_if(asked & F.col("ok")).alias("link_ok"))
    return a.join(b, "view", "full").withColumn("link_acc", F.round(F.col("link_ok") / F.nullif(F.col("link_total"), F.lit(0)), 3))


@query(f"""with t as ({SQL['serialised']}), c as (select length(text) as n, text like 'PART unit=mm %' as ok from t), l as (select list_sort(list(n)) as s, count(*) as n, count(*) filter (ok) as n_ok from c)
select n as n_texts, n_ok, s[(n / 2)::int + case when n % 2 = 1 then 1 else 0 end] as low_median, s[least(n - 1, floor(0.9 * n)::bigint) + 1] as p90, s[n] as longest from (select *, n from l)""".replace("s[(n / 2)::int + case when n % 2 = 1 then 1 else 0 end]", "s[(n - 1) // 2 + 1]").replace("(select *, n from l)", "l"))
def corpus_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many drawings have a text, and how long the texts are."""
    t = serialised(spark, sf_dir).select(F.lit(1).alias("one"), F.char_length("text").cast("long").alias("n"), F.startswith("text", F.lit("PART unit=mm ")).alias("ok"))
    h = t.groupBy("n").agg(F.count("*").alias("_n"), F.count_if("ok").alias("_ok"))
    # Lengths are few: a row for each, whatever the number of texts.
    upto = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("_n").over(Window.partitionBy())
    h = h.withColumns({"_upto": F.sum("_n").over(upto), "_total": total})
    return h.agg(F.sum("_n").alias("n_texts"), F.sum("_ok").alias("n_ok"), stats.at_rank("n", F.floor((F.col("_total") - 1) / 2)).alias("low_median"), stats.at_rank("n", stats.floor_index(90)).alias("p90"), F.max("n").alias("longest"))


@query("""with r as (select event_type as run, user_id as fixture, try_cast(props->>'$.k' as int) as k, value from events)
select run, count(*) filter (k is not null) as n_rows, count(*) filter (k is null) as n_skipped, round(sum(case when k is not null then coalesce(case when k >= 10 then k end, 0) end), 3)::bigint as score, count(distinct case when k is not null then fixture end) as n_fixtures from r group by run""")
def run_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result documents of runs: those that can't be read are passed over and counted, missing scores are 0."""
    k = F.expr("try_cast(get_json_object(props, '$.k') as int)")
    r = table(spark, sf_dir, "events").select(F.col("event_type").alias("run"), F.col("user_id").alias("fixture"), k.alias("k"))
    there = F.col("k").isNotNull()
    return r.groupBy("run").agg(
        F.count_if(there).alias("n_rows"),
        F.count_if(~there).alias("n_skipped"),
        F.sum(F.when(there, F.coalesce(F.when(F.col("k") >= 10, F.col("k")), F.lit(0)))).cast("long").alias("score"),
        F.count_distinct(F.when(there, F.col("fixture"))).alias("n_fixtures"),
    )


@query("""select p_partkey, p_partkey % 5 <> 3 as compiles, p_partkey % 5 <> 2 and p_partkey % 7 <> 0 as blends, case when p_partkey % 7 = 0 then 1 else 2 end as n_lines from part""")
def code_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a program parses and whether it blends, and its lines; programs are parsed, never run."""
    k = F.col("p_partkey")
    body = F.when(k % 7 == 0, "r = w.box(1)").otherwise(F.when(k % 5 == 2, "import cq\nr = w.box(2)").otherwise("import cq\nr = w.box(2).edges().fillet(1)"))
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(body, F.when(k % 5 == 3, ".hole(").otherwise("")).alias("source"))
    r = p.withColumn("s", kernels.stripped("source"))
    return r.select("p_partkey", F.col("s.error").isNull().alias("compiles"), F.contains("source", F.lit("fillet")).alias("blends"), (F.regexp_count("source", F.lit("\n")) + 1).alias("n_lines"))


@query(PRIMS + """, b as (select graph, x // 12 as bx, list_sort(list(distinct r * 10 + len % 10)) as rs from p group by all)
select graph, bx, len(k) as n_kept, array_to_string(k, ',') as kept from (select graph, bx, list_reduce(list_transform(rs, lambda v: [v]), lambda a, c: case when 100 * c[1] > 106 * a[len(a)] then list_append(a, c[1]) else a end) as k from b)""")
def contour_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Radii around one centre that are over 6 percent apart from the last that is kept, from the smallest on."""
    r = F.col("r") * 10 + F.col("len") % 10
    b = prims(spark, sf_dir).groupBy("graph", F.floor(F.col("x") / 12).cast("long").alias("bx")).agg(F.sort_array(F.collect_set(r)).alias("rs"))
    none = F.array().cast("array<bigint>")
    fold = lambda a, v: F.when((F.size(a) == 0) | (v * 100 > F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) * 106), F.array_append(a, v)).otherwise(a)
    b = b.withColumn("k", F.aggregate("rs", none, fold))
    return b.select("graph", "bx", F.size("k").cast("long").alias("n_kept"), F.array_join(F.transform("k", lambda v: v.cast("string")), ",").alias("kept"))
