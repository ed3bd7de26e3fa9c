"""Filters, counters, sets of ids and resolution of names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plateworks.operators import rules, selection
from plateworks.plans.registry import query
from plateworks.sources import table


@query("""select p_type as split, count(*) as n, count(*) filter (p_size not between 5 and 40) as n_out_of_band, count(*) filter (p_size between 5 and 40 and p_partkey % 11 = 0) as n_empty, count(*) filter (p_size between 5 and 40 and p_partkey % 11 <> 0) as n_kept from part group by 1""")
def band_filter_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exclusive counters: a part out of the band isn't counted as one without payload (those whose key divides by 11)."""
    p = table(spark, sf_dir, "part").select("p_type", "p_size", F.when(F.col("p_partkey") % 11 != 0, F.col("p_name")).otherwise("").alias("payload"))
    kind = rules.first_of({"out": ~F.col("p_size").between(5, 40), "empty": F.length("payload") == 0}, "kept")
    is_ = lambda v: F.count_if(F.col("kind") == v)
    return p.withColumn("kind", kind).groupBy(F.col("p_type").alias("split")).agg(F.count("*").alias("n"), is_("out").alias("n_out_of_band"), is_("empty").alias("n_empty"), is_("kept").alias("n_kept"))


@query("select doc_id, n_chars from documents where n_chars >= 200 and n_chars <= 4000")
def token_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").where(F.col("n_chars").between(200, 4000))


@query("select doc_id, n_chars from documents order by n_chars, doc_id limit 50")
def shortest_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 shortest, ties by id: a top-k report."""
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").orderBy("n_chars", "doc_id").limit(50)


@query("select source, count(*) as n, count(*) filter (strlen(text) > 4000) as n_too_large, sum(case when strlen(text) <= 4000 then strlen(text) end)::bigint as bytes_kept from documents group by source")
def size_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", F.octet_length("text").alias("b"))
    return d.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("b") > 4000).alias("n_too_large"), F.sum(F.when(F.col("b") <= 4000, F.col("b"))).cast("long").alias("bytes_kept"))


#: Needles of the two log classifiers over pages.
LOGIN, LIMITED = ("login", "sign in", "password"), ("cookie", "limit", "script")


@query("select page_id, contains(lower(html), 'login') or contains(lower(html), 'sign in') or contains(lower(html), 'password') as looks_login, contains(lower(html), 'cookie') or contains(lower(html), 'limit') or contains(lower(html), 'script') as looks_limited from pages")
def text_needles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", rules.contains_any(F.col("html"), LOGIN).alias("looks_login"), rules.contains_any(F.col("html"), LIMITED).alias("looks_limited"))


@query("""with o as (select distinct o_custkey as id from orders), c as (select c_custkey as id from customer), l as (select distinct l_suppkey as id from lineitem)
select id from o intersect select id from c intersect select id from l""")
def id_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = lambda t, c: table(spark, sf_dir, t).select(F.col(c).alias("id"))
    return selection.common(ids("orders", "o_custkey"), ids("customer", "c_custkey"), ids("lineitem", "l_suppkey"))


@query("""select distinct o_custkey as id from orders where o_custkey in (select c_custkey from customer) and o_custkey not in (select s_suppkey from supplier) and o_custkey not in (select p_partkey from part where p_size = 1)""")
def id_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = lambda t, c: table(spark, sf_dir, t).select(F.col(c).alias("id"))
    small = table(spark, sf_dir, "part").where("p_size = 1").select(F.col("p_partkey").alias("id"))
    excluded = ids("supplier", "s_suppkey").union(small).distinct()
    both = selection.common(ids("orders", "o_custkey"), ids("customer", "c_custkey"))
    return both.join(excluded, "id", "left_anti")


@query("""select c.c_custkey as id, coalesce(a.o_orderkey, b.o_orderkey) as source_key, case when a.o_orderkey is not null then 'first' when b.o_orderkey is not null then 'second' else 'missing' end as found
from customer c left join (select o_custkey, min(o_orderkey) as o_orderkey from orders where o_orderstatus = 'F' group by 1) a on a.o_custkey = c.c_custkey
left join (select o_custkey, min(o_orderkey) as o_orderkey from orders where o_orderstatus = 'O' group by 1) b on b.o_custkey = c.c_custkey""")
def source_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first name that exists, else the second, else nothing."""
    o = table(spark, sf_dir, "orders")
    one = lambda s, n: o.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderkey").alias(n))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).join(one("F", "a"), "id", "left").join(one("O", "b"), "id", "left")
    return c.select("id", F.coalesce("a", "b").alias("source_key"), rules.first_of({"first": F.col("a").isNotNull(), "second": F.col("b").isNotNull()}, "missing").alias("found"))


@query("""select o.o_orderkey as id, case when l.n is null then 'missing_pred' when c.c_custkey is null then 'missing_gt' when l.late then 'timeout' else 'scored' end as status
from orders o left join (select l_orderkey, count(*) as n, bool_or(l_shipdate > timestamp '1998-06-01') as late from lineitem group by 1) l on l.l_orderkey = o.o_orderkey
left join customer c on c.c_custkey = o.o_custkey and c.c_acctbal > 0""")
def typed_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions against ground truth: a missing prediction wins over a missing truth."""
    pred = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("n"), F.bool_or(F.col("l_shipdate") > F.lit("1998-06-01").cast("timestamp")).alias("late"))
    gt = table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey").join(pred, "id", "left").join(gt, F.col("o_custkey") == F.col("c_custkey"), "left")
    return o.select("id", rules.first_of({"missing_pred": F.col("n").isNull(), "missing_gt": F.col("c_custkey").isNull(), "timeout": F.col("late")}, "scored").alias("status"))


@query("select o_custkey as base, max(o_orderkey) as final_state, count(*) as n_states from orders group by 1")
def final_state_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("base")).agg(F.max("o_orderkey").alias("final_state"), F.count("*").alias("n_states"))


_STEM = r"case when name like '%.graph.json' then regexp_replace(name, '\.graph\.json$', '') when name like '%.json' then regexp_replace(name, '\.json$', '') else regexp_replace(name, '(.)\.[^.]*$', '\1') end"


@query(rf"with p as (select page_id, list_extract(string_split(url || case page_id % 4 when 0 then '/a.b.graph.json' when 1 then '/c.json' when 2 then '/d.e.step' else '' end, '/'), -1) as name from pages) select page_id, {_STEM} as stem from p")
def path_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of files: the page's address with a file name behind it."""
    names = F.when(F.col("page_id") % 4 == 0, "/a.b.graph.json").when(F.col("page_id") % 4 == 1, "/c.json").when(F.col("page_id") % 4 == 2, "/d.e.step").otherwise("")
    return table(spark, sf_dir, "pages").select("page_id", selection.stem(F.concat("url", names)).alias("stem"))


@query(r"""with s as (select conv_id, case conv_id % 3 when 0 then '{"ids": ["' || string_agg(turn::varchar, '","' order by turn) || '"]}' when 1 then '["' || string_agg(turn::varchar, '","' order by turn) || '"]' else string_agg(turn::varchar, chr(10) order by turn) end as body from conversations group by conv_id)
select conv_id, (select count(*) from conversations c where c.conv_id = s.conv_id) as n_ids, (select string_agg(turn::varchar, ',' order by turn) from conversations c where c.conv_id = s.conv_id) as ids from s""")
def id_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids written as an object, a list or lines, read by what the body turns out to be."""
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("_t"))
    words = F.transform("_t", lambda x: x.cast("string"))
    quoted = F.concat(F.lit('["'), F.array_join(words, '","'), F.lit('"]'))
    body = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit('{"ids": '), quoted, F.lit("}"))).when(F.col("conv_id") % 3 == 1, quoted).otherwise(F.array_join(words, "\n"))
    t = t.select("conv_id", body.alias("body"))
    as_object, as_list = F.from_json("body", "ids array<string>")["ids"], F.from_json("body", "array<string>")
    ids = F.coalesce(F.when(F.col("body").startswith("{"), as_object), F.when(F.col("body").startswith("["), as_list), F.split("body", "\n"))
    return t.select("conv_id", F.size(ids).cast("long").alias("n_ids"), F.array_join(ids, ",").alias("ids"))


@query("""with f as (select l_orderkey as graph, case l_returnflag when 'A' then '.png' when 'N' then '.scan.png' else '.jpg' end as ext, case l_returnflag when 'A' then 1 when 'N' then 2 else 3 end as rank from lineitem)
select graph, arg_min(ext, rank) as image from f group by graph""")
def pair_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first existing kind of image of each graph."""
    flag = F.col("l_returnflag")
    ext = F.when(flag == "A", ".png").when(flag == "N", ".scan.png").otherwise(".jpg")
    rank = F.when(flag == "A", 1).when(flag == "N", 2).otherwise(3)
    f = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("graph"), ext.alias("image"), rank.alias("rank"))
    return selection.first_by(f, ["graph"], F.col("rank"), ["image"])


@query("""with b as (select item_id, string_split(text, '.') as lines from benchmark), d as (select row_number() over () as doc, string_split(text, '.') as lines from documents),
p as (select item_id, doc, b.lines as x, d.lines as y, unnest(range(1, len(b.lines) + 1)) as pos from b join d on len(b.lines) = len(d.lines)),
q as (select item_id, doc, count(*) as n, count(*) filter (x[pos] = y[pos]) as same from p group by all),
l as (select item_id, count(*) filter (n - same <= greatest(20, n // 200)) as n_leaks from q group by item_id)
select item_id, coalesce(n_leaks, 0) as n_leaks from benchmark left join l using (item_id)""")
def leak_positional_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items against all documents, line by line (here: sentence): as many lines and few that differ are a leak."""
    cut = lambda t, *key: table(spark, sf_dir, t).select(*key, F.split("text", r"\.", -1).alias("lines")).withColumn("n", F.size("lines"))
    items, docs = cut("benchmark", "item_id"), cut("documents")
    # Up to so many lines all may differ, so that documents count by their number of lines.
    may = F.greatest(F.lit(20), F.floor(F.col("n") / 200).cast("int"))
    short = items.where(F.col("n") <= may).join(docs.where(F.col("n") <= may).groupBy("n").agg(F.count("*").alias("_l")), "n").select("item_id", "_l")
    # Longer ones are cut into one run more than lines may differ: a leak shares a whole run, so equal runs in one place are what is joined.
    bounds = F.sequence(F.lit(0), may)
    begin = lambda i: F.floor(i * F.col("n") / (may + 1)).cast("int")
    runs = F.transform(bounds, lambda i: F.struct(i.alias("run"), F.xxhash64(F.slice("lines", begin(i) + 1, begin(i + 1) - begin(i))).alias("h")))
    # Equal documents count together.
    long = docs.where(F.col("n") > may).groupBy("n", "lines").agg(F.count("*").alias("times")).withColumn("doc", F.xxhash64("lines")).withColumn("doc2", F.xxhash64("lines", F.lit(2)))
    asked = items.where(F.col("n") > may)
    places = lambda df, *key: df.select("n", *key, F.explode(runs).alias("r")).select("n", *key, "r.run", "r.h")
    pairs = places(asked, "item_id").join(places(long, "doc", "doc2"), ["n", "run", "h"]).select("item_id", "n", "doc", "doc2").distinct()
    both = pairs.join(asked.select("item_id", "lines"), "item_id").join(long.select("doc", "doc2", "times", F.col("lines").alias("theirs")), ["doc", "doc2"])
    same = F.size(F.filter(F.zip_with("lines", "theirs", lambda a, b: a == b), lambda x: x))
    found = both.where(F.col("n") - same <= may).groupBy("item_id").agg(F.sum("times").alias("_l"))
    leaks = short.unionByName(found).groupBy("item_id").agg(F.sum("_l").alias("_l"))
    return items.select("item_id").join(leaks, "item_id", "left").select("item_id", F.coalesce("_l", F.lit(0)).cast("long").alias("n_leaks"))


@query("select o_orderkey as id, coalesce(case when o_orderkey % 3 = 0 then o_orderpriority end, case when o_orderkey % 3 = 1 then o_orderstatus end, 'visible') as line_role from orders")
def alias_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field under its new name, its older one, or its default."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 3
    return o.select(F.col("o_orderkey").alias("id"), rules.alias(F.when(k == 0, F.col("o_orderpriority")), F.when(k == 1, F.col("o_orderstatus")), F.lit("visible")).alias("line_role"))


@query("select key, coalesce(cli, file, base) as value, cli is not null or file is not null as changed from (select n_nationkey as key, case when n_nationkey % 5 = 0 then n_name end as cli, case when n_nationkey % 3 = 0 then lower(n_name) end as file, r_name as base from nation join region on n_regionkey = r_regionkey)")
def config_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defaults under a file under a command line; regions are the defaults of their nations."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    cli, file = F.when(F.col("n_nationkey") % 5 == 0, F.col("n_name")), F.when(F.col("n_nationkey") % 3 == 0, F.lower("n_name"))
    return n.select(F.col("n_nationkey").alias("key"), F.coalesce(cli, file, F.col("r_name")).alias("value"), (cli.isNotNull() | file.isNotNull()).alias("changed"))
