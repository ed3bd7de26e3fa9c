"""Text records, prompts and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plateworks.operators import rules, text
from plateworks.plans.registry import query
from plateworks.sources import table

_TEXT = """with t as (select l_partkey as id, 'PART ' || case when l_partkey % 9 = 0 then 'unquantised' else 'bbox=' || (l_partkey % 50) || ',' || (l_partkey % 7) || ',-3.5 ext=' || (l_partkey % 200) || '.25' end || chr(10)
 || string_agg('VIEW ' || view || chr(10) || rows, chr(10) order by view) as body
 from (select l_partkey, l_returnflag as view, string_agg('L ' || l_quantity::int, chr(10) order by l_quantity, l_orderkey, l_linenumber, l_suppkey) as rows from lineitem group by all) group by l_partkey)
"""


def serialized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, body: a text of line records for each part, made of its line items."""
    li = table(spark, sf_dir, "lineitem")
    row = F.struct("l_quantity", "l_orderkey", "l_linenumber", "l_suppkey")
    views = li.groupBy("l_partkey", "l_returnflag").agg(F.array_sort(F.collect_list(row)).alias("r"))
    lines = F.array_join(F.transform("r", lambda x: F.concat(F.lit("L "), x["l_quantity"].cast("int").cast("string"))), "\n")
    views = views.select("l_partkey", F.struct(F.col("l_returnflag").alias("v"), F.concat(F.lit("VIEW "), F.col("l_returnflag"), F.lit("\n"), lines).alias("t")).alias("s"))
    k = F.col("l_partkey")
    text_of = lambda c: c.cast("string")
    head = F.when(k % 9 == 0, "PART unquantised").otherwise(F.concat(F.lit("PART bbox="), text_of(k % 50), F.lit(","), text_of(k % 7), F.lit(",-3.5 ext="), text_of(k % 200), F.lit(".25")))
    body = views.groupBy("l_partkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["t"]), "\n").alias("b"))
    return body.select(k.alias("id"), F.concat(head, F.lit("\n"), "b").alias("body"))


@query(_TEXT + r"""select id, md5(body) as digest, len(string_split(body, chr(10))) as n_lines from t""")
def line_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serialized(spark, sf_dir).select("id", F.md5(F.col("body").cast("binary")).alias("digest"), F.size(F.split("body", "\n")).cast("long").alias("n_lines"))


@query(_TEXT + r"""select id, list_max(list_transform(string_split(nullif(regexp_extract(body, 'bbox=([-0-9.,]+)', 1), ''), ','), lambda x: abs(x::double))) as largest, try_cast(regexp_extract(body, 'ext=([-0-9.]+)', 1) as double) as ext,
 case when regexp_extract(body, 'bbox=([-0-9.,]+)', 1) = '' then null else round(try_cast(regexp_extract(body, 'ext=([-0-9.]+)', 1) as double) / list_max(list_transform(string_split(regexp_extract(body, 'bbox=([-0-9.,]+)', 1), ','), lambda x: abs(try_cast(x as double)))), 6) end as ratio from t""")
def header_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box, extent and ratio of serialized texts; null where they are not quantised."""
    box, ext = text.part_header(F.col("body"))
    t = serialized(spark, sf_dir).select("id", box.alias("box"), ext.alias("ext"))
    t = t.withColumn("largest", F.array_max(F.transform("box", lambda x: F.abs(x))))
    return t.select("id", "largest", "ext", F.when(F.col("box").isNotNull(), F.round(rules.extent_ratio(F.col("ext"), F.col("largest")), 6)).alias("ratio"))


@query("select l_partkey as id, l_returnflag as view, count(*) as n_rows, sum(l_quantity::int)::bigint as total from lineitem group by all")
def view_context_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each view, read back from the text."""
    r = text.records(serialized(spark, sf_dir), "id", "body").where(F.col("line").startswith("L "))
    return r.groupBy("id", "view").agg(F.count("*").alias("n_rows"), F.sum(F.substring_index("line", " ", -1).cast("long")).alias("total"))


@query("select conv_id, string_agg('# ' || role || chr(10) || text, chr(10) || chr(10) order by turn) as prompt, sum(length(text))::bigint > 100000 as too_long from conversations group by conv_id")
def prompt_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worked examples in order, with the guard on length."""
    c = table(spark, sf_dir, "conversations")
    row = F.struct("turn", F.concat(F.lit("# "), F.col("role"), F.lit("\n"), F.col("text")).alias("t"))
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("r"), F.sum(F.char_length("text")).alias("n"))
    return g.select("conv_id", F.array_join(F.transform("r", lambda x: x["t"]), "\n\n").alias("prompt"), (F.col("n") > 100000).alias("too_long"))


# crc32 bit by bit, over the bytes of a text.
@query("select p_partkey, xor(list_reduce([4294967295::bigint] || list_transform(string_split('0:' || p_partkey, ''), lambda x: ascii(x)::bigint), lambda c, b: list_reduce([xor(c, b)] || [0::bigint, 0, 0, 0, 0, 0, 0, 0], lambda x, _: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) as seed from part")
def seed_crc32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seed for each record: crc32 of the run's seed and the record's id."""
    return table(spark, sf_dir, "part").select("p_partkey", F.crc32(F.concat(F.lit("0:"), F.col("p_partkey").cast("string")).cast("binary")).alias("seed"))


@query("select p_partkey, case when p_size % 3 = 0 then '<neg>' else '' end || '<c' || lpad(p_size::varchar, 4, '0') || '>' as token from part")
def coordinate_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("p_size") % 3 == 0, -F.col("p_size")).otherwise(F.col("p_size"))
    return table(spark, sf_dir, "part").select("p_partkey", text.coordinate(v, 4).alias("token"))


@query("select count(*) as n, min(p_size) as low, max(p_size) as high, count(distinct p_size) = max(p_size) - min(p_size) + 1 as contiguous from part")
def vocabulary_contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.agg(F.count("*").alias("n"), F.min("p_size").alias("low"), F.max("p_size").alias("high"), (F.count_distinct("p_size") == F.max("p_size") - F.min("p_size") + 1).alias("contiguous"))


@query("select page_id, translate(url, '/: ', '___') as slug from pages")
def model_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.slug(F.col("url")).alias("slug"))


@query("""with l as (select doc_id, list_transform(string_split(text, ' '), lambda w: length(w)::int) as w from documents), s as (select doc_id, w, list_transform(w, lambda x, i: case when i = 6 then x + 1 else x end)[1:10] as p from l),
n as (select doc_id, w, coalesce(list_min(list_filter(range(1, greatest(len(p), len(w)) + 1), lambda i: p[i] is distinct from w[i])) - 1, len(w)) as k from s)
select doc_id, k as masked, len(w) as n, list_sum(list_transform(w, lambda x, i: case when i <= k then -100 else x end))::bigint as total from n""")
def label_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of a text whose prompt is its first words, the sixth of which differs: word lengths stand for ids."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.transform(F.split("text", " "), lambda w: F.char_length(w)).alias("w"))
    d = d.withColumn("p", F.slice(F.transform("w", lambda x, i: F.when(i == 5, x + 1).otherwise(x)), 1, 10))
    d = d.withColumn("l", text.masked_labels(F.col("p"), F.col("w")))
    return d.select("doc_id", F.size(F.filter("l", lambda x: x == -100)).cast("long").alias("masked"), F.size("l").cast("long").alias("n"), F.aggregate("l", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("with g as (select label, max(vec_id) // 100 + 5 as longest from embeddings group by label) select vec_id, (longest - vec_id // 100)::bigint as n_pad, longest::bigint as n from embeddings join g using (label)")
def left_pad_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of a batch (a label) padded on the left to its longest; lengths come from the ids."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.floor(F.col("vec_id") / 100).cast("int").alias("n"))
    g = e.groupBy("label").agg((F.max("n") + 5).alias("longest"))
    d = e.join(g, "label").withColumn("ids", F.array_repeat(F.lit(7), F.col("n"))).withColumn("out", text.left_padded(F.col("ids"), F.col("longest")))
    return d.select("vec_id", F.size(F.filter("out", lambda x: x == 0)).cast("long").alias("n_pad"), F.size("out").cast("long").alias("n"))


@query("""with l as (select doc_id, case when doc_id % 7 = 0 then '' when doc_id % 5 = 0 then '{"id": ' || doc_id else '{"id": ' || doc_id || ', "lang": "' || lang || '"}' end as line from documents)
select doc_id as line_no, case when line = '' then 'blank' when line like '%}' then 'ok' else 'malformed' end as status, case when line like '%}' then doc_id end as id from l where line <> ''""")
def jsonl_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of records: blank ones are passed over, broken ones are kept with their number and don't stop the read."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    whole = F.concat(F.lit('{"id": '), k.cast("string"), F.lit(', "lang": "'), F.col("lang"), F.lit('"}'))
    line = F.when(k % 7 == 0, "").when(k % 5 == 0, F.concat(F.lit('{"id": '), k.cast("string"))).otherwise(whole)
    r = d.select(k.alias("line_no"), line.alias("line")).where("line <> ''").withColumn("v", F.try_parse_json("line"))
    status = F.when(F.col("v").isNull(), "malformed").otherwise("ok")
    return r.select("line_no", status.alias("status"), F.try_variant_get("v", "$.id", "bigint").alias("id"))


@query("select p_type as kind, '| ' || left(p_type, 8) || ' | ' || count(*) || ' | ' || coalesce(max(case when p_size > 49 then p_size end)::varchar, '-') || ' |' as row from part group by p_type")
def markdown_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a report: names cut to 8 characters, a dash for what is missing."""
    g = table(spark, sf_dir, "part").groupBy("p_type").agg(F.count("*").alias("n"), F.max(F.when(F.col("p_size") > 49, F.col("p_size"))).alias("m"))
    row = F.concat(F.lit("| "), F.left("p_type", F.lit(8)), F.lit(" | "), F.col("n").cast("string"), F.lit(" | "), F.coalesce(F.col("m").cast("string"), F.lit("-")), F.lit(" |"))
    return g.select(F.col("p_type").alias("kind"), row.alias("row"))


@query("select p_partkey, 'description: |' || chr(10) || '  ' || replace(p_name, ' ', chr(10) || '  ') || chr(10) as yaml from part")
def yaml_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block scalar for each part, one indented line a word."""
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("description: |\n  "), F.replace(F.col("p_name"), F.lit(" "), F.lit("\n  ")), F.lit("\n")).alias("yaml"))


@query("select page_id, case when contains(html, 'StdFail') then 'Kernel:StdFail' when contains(html, '<script') then 'Kernel:script' when contains(html, 'href') then 'Kernel:link' else 'other' end as error_class from pages")
def error_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    has = lambda s: F.contains("html", F.lit(s))
    return table(spark, sf_dir, "pages").select("page_id", rules.first_of({"Kernel:StdFail": has("StdFail"), "Kernel:script": has("<script"), "Kernel:link": has("href")}, "other").alias("error_class"))
