"""Bundling documents with labels: pairing, quarantine, statistics.

The given tables hold no drawings. Word counts stand for token counts, characters a word for the extent ratio.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plateworks.operators import rules, stats
from plateworks.plans.registry import query
from plateworks.shared import written
from plateworks.sources import table

WARN, FAIL = 6.0, 7.0


def audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, n_words, ratio, severity, status: documents with their labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", F.regexp_count("text", F.lit(r"\S+")).alias("n_words"))
    pairs = docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    ratio = rules.extent_ratio(F.col("n_chars").cast("double"), F.col("n_words").cast("double"))
    level = rules.severity(F.col("ratio"), F.col("toxic") == 0, WARN, FAIL)
    d = pairs.withColumn("ratio", ratio).withColumn("severity", F.when(F.col("quality").isNotNull(), level))
    kind = rules.first_of({"SKIP": F.col("quality").isNull(), "QUARANTINE": F.col("severity") == "quarantine"}, "OK")
    return d.withColumn("status", kind)


AUDITED = r"""
with d as (select doc_id, lang, n_chars, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))::int as n_words from documents),
p as (select d.*, l.quality, l.toxic, case when n_words = 0 then 'inf'::double else n_chars::double / n_words end as ratio from d left join labels l using (doc_id)),
s as (select *, case when quality is null then null when toxic <> 0 or ratio > 7.0 then 'quarantine' when ratio <= 6.0 then 'pass' else 'warning' end as severity from p),
a as (select *, case when quality is null then 'SKIP' when severity = 'quarantine' then 'QUARANTINE' else 'OK' end as status from s)
"""

DIST = """count(*) as n, min(v) as min, floor(median(v))::bigint as median, round(sum(v)::double / count(*), 1) as mean,
 list_sort(list(v))[(least(count(*) - 1, floor(0.9::double * count(*))) + 1)::int] as p90,
 list_sort(list(v))[(least(count(*) - 1, floor(0.95::double * count(*))) + 1)::int] as p95,
 list_sort(list(v))[(least(count(*) - 1, floor(0.99::double * count(*))) + 1)::int] as p99, max(v) as max"""


@query(AUDITED + f""", t as (select lang, count(*) as n_pairs, count(*) filter (status = 'SKIP') as n_skipped, count(*) filter (status = 'QUARANTINE') as n_quarantined,
 count(*) filter (severity = 'warning') as n_warned, count(*) filter (status = 'OK' and n_words + 40 > 512) as over_512 from a group by lang),
k as (select lang, {DIST} from (select lang, n_words as v from a where status = 'OK') group by lang)
select lang, n_pairs, n_skipped, n_quarantined, n_warned, over_512, n, min, median, mean, p90, p95, p99, max from t left join k using (lang)""")
def audited_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a language: statuses, warnings, cap coverage and the distribution of what is kept. Documents are read once, into counts."""
    counts = written(audited(spark, sf_dir).groupBy("lang", "status", "severity", "n_words").agg(F.count("*").alias("_n")), "audited")
    total = lambda c: F.sum(F.when(c, F.col("_n")).otherwise(0))
    ok = F.col("status") == "OK"
    totals = counts.groupBy("lang").agg(
        F.sum("_n").alias("n_pairs"),
        total(F.col("status") == "SKIP").alias("n_skipped"),
        total(F.col("status") == "QUARANTINE").alias("n_quarantined"),
        total(F.col("severity") == "warning").alias("n_warned"),
        total(ok & (F.col("n_words") + 40 > 512)).alias("over_512"),
    )
    kept = counts.where(ok).groupBy("lang", "n_words").agg(F.sum("_n").alias("_n"))
    return totals.join(stats.described(stats.ranked(kept, ["lang"], "n_words"), ["lang"], "n_words"), "lang", "left")


@query(AUDITED + "select doc_id, status, severity from a")
def pair_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(spark, sf_dir).select("doc_id", "status", "severity")


@query(AUDITED + ", k as (select n_words from a where status = 'OK'), c as (select unnest([64, 128, 256, 512, 1024, 2048]) as cap) select cap, count(*) filter (n_words + 40 > cap) as pairs_over, round(100 * count(*) filter (n_words + 40 > cap) / count(*), 1) as pct_over, count(*) filter (n_words + 40 <= cap) as pairs_kept from k, c group by cap")
def cap_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.cap_coverage(audited(spark, sf_dir).where(F.col("status") == "OK"), "n_words", (64, 128, 256, 512, 1024, 2048))


@query(f"select lang, {DIST} from (select lang, n_chars as v from documents) group by lang")
def dist_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.distribution(table(spark, sf_dir, "documents"), ["lang"], "n_chars")


_RATIO = "case when o_custkey % 17 = 0 then 'inf'::double else o_totalprice / (o_custkey % 50 + 1) end"


def _ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as audit rows: the price is the extent, a function of the customer the largest side (null: not finite)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_custkey", "o_totalprice")
    side = F.when(F.col("o_custkey") % 17 != 0, (F.col("o_custkey") % 50 + 1).cast("double"))
    return o.withColumn("ratio", rules.extent_ratio(F.col("o_totalprice"), side))


@query(f"""with r as (select o_orderpriority, {_RATIO} as v from orders),
f as (select o_orderpriority, list_sort(list(v)) as s, count(*) as n from r where not isinf(v) group by 1)
select o_orderpriority, (select count(*) from r where r.o_orderpriority = f.o_orderpriority and isinf(v)) as n_nonfinite,
 s[(least(n - 1, floor(0.5::double * n)) + 1)::int] as p50, s[(least(n - 1, floor(0.9::double * n)) + 1)::int] as p90, s[(least(n - 1, floor(0.99::double * n)) + 1)::int] as p99, s[n] as max from f""")
def dist_nonfinite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.finite_distribution(_ratios(spark, sf_dir), ["o_orderpriority"], "ratio")


@query("""with s as (select p_type, list_sort(list(p_size)) as s, count(*) as n from part group by 1)
select p_type, s[1] as min, s[(round_even((n - 1) * 0.25::double, 0) + 1)::int] as p25, s[(round_even((n - 1) * 0.5::double, 0) + 1)::int] as median, s[(round_even((n - 1) * 0.75::double, 0) + 1)::int] as p75, s[n] as max from s""")
def dist_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.quartiles_rounded(table(spark, sf_dir, "part"), ["p_type"], "p_size")


@query(f"""with r as (select o_orderkey, {_RATIO} as ratio, o_custkey % 23 <> 0 as in_domain from orders),
s as (select *, case when not in_domain or ratio > 9000 then 'quarantine' when ratio <= 3000 then 'pass' else 'warning' end as severity,
 list_filter([case when ratio > 9000 then 'extent_ratio' end, case when not in_domain then 'absolute_bbox_mm' end], lambda x: x is not null) as rs from r)
select o_orderkey, severity, array_to_string(rs, ',') as reasons from s where severity <> 'pass'""")
def severity_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offenders with their severity and reasons; what passes is left out."""
    inside = F.col("o_custkey") % 23 != 0
    r = _ratios(spark, sf_dir).withColumn("severity", rules.severity(F.col("ratio"), inside, 3000, 9000))
    why = rules.reasons({"extent_ratio": F.col("ratio") > 9000, "absolute_bbox_mm": ~inside})
    return r.where(F.col("severity") != "pass").select("o_orderkey", "severity", F.array_join(why, ",").alias("reasons"))


@query(f"select o_orderpriority, t as threshold, count(*) filter (v > t) as n_above from (select o_orderpriority, {_RATIO} as v from orders), (select unnest([2.0, 3.0, 5.0, 10.0, 20.0, 100.0, 1000.0])::double as t) group by all")
def threshold_exceedance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.exceedance(_ratios(spark, sf_dir), ["o_orderpriority"], "ratio", (2, 3, 5, 10, 20, 100, 1000))


@query("select source, min(n_chars) as min, max(n_chars) as max, (sum(n_chars) // count(*))::bigint as mean from documents group by source")
def target_char_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").groupBy("source")
    return d.agg(F.min("n_chars").alias("min"), F.max("n_chars").alias("max"), F.floor(F.sum("n_chars") / F.count("*")).cast("long").alias("mean"))
