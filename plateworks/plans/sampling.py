"""Bins, allocation and samples of parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plateworks.operators import selection
from plateworks.plans.registry import query
from plateworks.sources import table

EDGES = selection.log_edges(1, 50, 6)
_BIN = " + ".join(f"(p_size >= {e})::int" for e in EDGES)
_PARTS = f"with b as (select *, {_BIN} as bin from part), p as (select p_type, bin, count(*) as pool from b group by all)\n"
_FILL = _PARTS + """, q as (select *, (sum(pool) over (partition by p_type) // 3)::bigint as want from p),
r as (select *, want - coalesce(sum(pool) over (partition by p_type order by pool, bin rows between unbounded preceding and 1 preceding), 0) as lft,
  count(*) over (partition by p_type) - row_number() over (partition by p_type order by pool, bin) + 1 as bins from q),
o as (select *, max((pool * bins > lft)::int) over (partition by p_type order by pool, bin rows between unbounded preceding and current row) = 1 as opn from r),
k as (select *, want - sum(case when opn then 0 else pool end) over (partition by p_type) as rem, sum(opn::int) over (partition by p_type) as k, sum(opn::int) over (partition by p_type order by bin) as nth from o),
f as (select p_type, bin, pool, (case when opn then rem // k + (nth <= rem % k)::int else pool end)::bigint as alloc from k)
"""


def binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size")
    return p.withColumn("bin", selection.bin_of(F.col("p_size"), EDGES))


@query(_PARTS + "select bin, sum(pool)::bigint as pool from p group by bin")
def log_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binned(spark, sf_dir).groupBy("bin").agg(F.count("*").alias("pool"))


def filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the parts of each type, filled into its bins."""
    pools = binned(spark, sf_dir).groupBy("p_type", "bin").agg(F.count("*").alias("pool"))
    wanted = F.floor(F.sum("pool").over(Window.partitionBy("p_type")) / 3)
    return selection.water_fill(pools, ["p_type"], "bin", "pool", wanted)


@query(_FILL + "select p_type, bin, pool, alloc from f")
def water_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filled(spark, sf_dir)


@query(_FILL + ", n as (select b.p_partkey, b.p_type, b.bin, row_number() over (partition by b.p_type, b.bin order by md5('7:' || p_partkey), p_partkey) as n from b) select n.p_partkey, n.p_type, n.bin from n join f using (p_type, bin) where n.n <= f.alloc")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many parts of each bin as it was given, in the order of a seeded hash."""
    drawn = selection.draw(F.col("p_partkey"), 7)
    b = selection.numbered_spread(binned(spark, sf_dir), ["p_type", "bin"], [drawn, "p_partkey"], F.substring(drawn, 1, 3))
    return b.join(filled(spark, sf_dir), ["p_type", "bin"]).where("n <= alloc").select("p_partkey", "p_type", "bin")


@query("select p_partkey from part where p_partkey % 11 <> 0 order by md5('9:' || p_partkey), p_partkey limit 100")
def iid_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 parts that have a payload: a sample of fixed size."""
    p = table(spark, sf_dir, "part").where(F.col("p_partkey") % 11 != 0).select("p_partkey")
    return p.orderBy(selection.draw(F.col("p_partkey"), 9), "p_partkey").limit(100)


@query("select doc_id, lang, row_number() over (partition by lang order by n_chars, doc_id) as place, n_chars from documents")
def length_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank by length within the language, ties by id."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return selection.numbered_spread(d, ["lang"], ["n_chars", "doc_id"], selection.slice_of(F.col("n_chars")), "place")


@query("select o_orderkey, (o_totalprice * 1000 / 0.214)::double::bigint // 1000 as tokens, ceil((o_custkey + 1) / 16)::bigint // 4 as steps from orders")
def budget_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that a memory budget allows and optimizer steps of an epoch."""
    o = table(spark, sf_dir, "orders")
    tokens = F.floor(F.bround(F.col("o_totalprice") * 1000 / F.lit(0.214), 0) / 1000)
    return o.select("o_orderkey", tokens.cast("long").alias("tokens"), F.floor(F.ceil((F.col("o_custkey") + 1) / 16) / 4).cast("long").alias("steps"))
