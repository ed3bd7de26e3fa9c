"""Evaluation rows and run reports, from the events table.

An event is an evaluation row: its type is the run, its user the fixture, value / 500 the score (null, that is unscored, where the
number in props is under 10), and the number in props tells the kind of failure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plateworks.operators import rules, stats
from plateworks.plans.registry import query
from plateworks.shared import written
from plateworks.sources import table

#: Failure labels in the order in which they are tested.
FAILURES = ("timeout", "crash", "empty")


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, run, fixture, k, iou, error_type."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("run"), F.col("user_id").alias("fixture"), "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    kind = rules.first_of({"timeout": F.col("k") < 4, "crash": F.col("k") < 7, "empty": F.col("k") < 10}, "ok")
    return e.withColumn("iou", F.when(F.col("k") >= 10, F.col("value") / 500)).withColumn("error_type", kind)


ROWS = """with e as (select event_id, event_type as run, user_id as fixture, value, (props->>'$.k')::int as k from events),
r as (select *, case when k >= 10 then value / 500 end as iou, case when k < 4 then 'timeout' when k < 7 then 'crash' when k < 10 then 'empty' else 'ok' end as error_type from e)
"""


@query(ROWS + """select run, count(*) as n, round(count(*) filter (error_type = 'ok') / count(*), 4) as ok_rate, count(iou) as iou_scored_n, round(avg(iou), 4) as mean_iou, round(median(iou), 4) as median_iou,
 round(avg(case when k >= 50 then iou end), 4) as mean_iou_valid_only, round(count(*) filter (iou >= 0.5) / count(*), 4) as iou_50_rate, round(count(*) filter (iou >= 0.9) / count(*), 4) as iou_90_rate from r group by run""")
def eval_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates over all rows, means over scored ones."""
    r = rows(spark, sf_dir)
    rate = lambda c: F.round(F.count_if(c) / F.count("*"), 4)
    main = r.groupBy("run").agg(
        F.count("*").alias("n"),
        rate(F.col("error_type") == "ok").alias("ok_rate"),
        F.count("iou").alias("iou_scored_n"),
        F.round(F.avg("iou"), 4).alias("mean_iou"),
        F.round(F.avg(F.when(F.col("k") >= 50, F.col("iou"))), 4).alias("mean_iou_valid_only"),
        rate(F.col("iou") >= 0.5).alias("iou_50_rate"),
        rate(F.col("iou") >= 0.9).alias("iou_90_rate"),
    )
    h = stats.histogram(r, ["run"], "iou").groupBy("run").agg(F.round(stats.true_median("iou"), 4).alias("median_iou"))
    return main.join(h, "run", "left")


@query(ROWS + "select run, error_type, count(*) as n, row_number() over (partition by run order by count(*) desc, min(event_id)) as place from r group by run, error_type")
def error_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.error_histogram(rows(spark, sf_dir), ["run"], "error_type", "event_id")


@query(ROWS + """, s as (select distinct fixture from r), g as (select run, fixture, max(iou) as iou from r group by all), x as (select distinct run from r),
f as (select x.run, coalesce(g.iou, 0) as v, g.iou is not null as ok from x cross join s left join g on g.run = x.run and g.fixture = s.fixture)
select run, count(*) as n, round(avg(v), 6) as mean, round(median(v), 6) as median, round(count(*) filter (ok) / count(*), 6) as valid_rate from f group by run""")
def fold_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best score of each fixture of the whole subset; missing and unscored ones count as 0."""
    r = rows(spark, sf_dir)
    best = written(r.groupBy("run", "fixture").agg(F.max("iou").alias("iou")), "best")
    fixtures = best.agg(F.count_distinct("fixture").alias("_all"))  # one row
    # Fixtures that a run lacks are so many zeros more.
    v = F.coalesce("iou", F.lit(0.0))
    counted = best.groupBy("run", v.alias("v")).agg(F.count("*").alias("_n"))
    missing = best.groupBy("run").agg(F.count("*").alias("_k")).join(F.broadcast(fixtures)).select("run", F.lit(0.0).alias("v"), (F.col("_all") - F.col("_k")).alias("_n")).where("_n > 0")
    counted = counted.unionByName(missing).groupBy("run", "v").agg(F.sum("_n").alias("_n"))
    h = stats.ranked(counted, ["run"], "v")
    mean = F.sum(F.col("v") * F.col("_n")) / F.sum("_n")
    folded = h.groupBy("run").agg(F.sum("_n").alias("n"), F.round(mean, 6).alias("mean"), F.round(stats.true_median("v"), 6).alias("median"))
    valid = best.groupBy("run").agg(F.count("iou").alias("_ok"))
    return folded.join(valid, "run").select("run", "n", "mean", "median", F.round(F.col("_ok") / F.col("n"), 6).alias("valid_rate"))


SCORES = ROWS + """, s as (select run, fixture, arg_max(case when k < 5 then 'missing' when k < 10 then 'invalid' else 'valid' end, event_id) as status, coalesce(arg_max(coalesce(iou, 0), event_id), 0) as score,
 arg_max(case when k >= 20 then value else null end, event_id) as shape0, max_by(k, event_id) as k from r group by all)
"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, fixture, status, score, k: the last row of each fixture in each run, missing scores as 0."""
    status = rules.first_of({"missing": F.col("k") < 5, "invalid": F.col("k") < 10}, "valid")
    r = rows(spark, sf_dir).withColumn("status", status).withColumn("score", F.coalesce("iou", F.lit(0.0)))
    last = r.groupBy("run", "fixture").agg(F.max_by(F.struct("status", "score", "k"), "event_id").alias("x"))
    return last.select("run", "fixture", "x.*")


@query(SCORES + "select run, count(*) as n, round(avg(score), 4) as score_mean, round(avg(case when k >= 20 then k end), 4) as shape_mean, round(count(*) filter (status = 'valid') / count(*), 4) as validity_rate, count(*) filter (status = 'valid') as n_valid, count(*) filter (status = 'invalid') as n_invalid, count(*) filter (status = 'missing') as n_missing from s group by run")
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(scores(spark, sf_dir))


def report(s: DataFrame) -> DataFrame:
    """Aggregate of each run: means with zeros, means over what is not null, counts of statuses."""
    is_ = lambda v: F.count_if(F.col("status") == v)
    return s.groupBy("run").agg(
        F.count("*").alias("n"),
        F.round(F.avg("score"), 4).alias("score_mean"),
        F.round(F.avg(F.when(F.col("k") >= 20, F.col("k"))), 4).alias("shape_mean"),
        F.round(is_("valid") / F.count("*"), 4).alias("validity_rate"),
        is_("valid").alias("n_valid"),
        is_("invalid").alias("n_invalid"),
        is_("missing").alias("n_missing"),
    )


@query(SCORES + ", c as (select fixture from s group by fixture having count(distinct run) = (select count(distinct run) from s)) select run, count(*) as n, round(avg(score), 4) as score_mean, round(avg(case when k >= 20 then k end), 4) as shape_mean, round(count(*) filter (status = 'valid') / count(*), 4) as validity_rate, count(*) filter (status = 'valid') as n_valid, count(*) filter (status = 'invalid') as n_invalid, count(*) filter (status = 'missing') as n_missing from s where fixture in (select fixture from c) group by run")
def paired_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over fixtures that all runs have."""
    s = scores(spark, sf_dir)
    runs = s.agg(F.count_distinct("run").alias("n_runs"))
    common = s.groupBy("fixture").agg(F.count_distinct("run").alias("n_runs")).join(F.broadcast(runs), "n_runs", "left_semi")
    return report(s.join(common, "fixture", "left_semi"))


@query(SCORES + "select fixture, max(score) filter (run = 'click') as click, max(score) filter (run = 'view') as view, max(score) filter (run = 'purchase') as purchase from s group by fixture")
def pivot_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a fixture, a column for each named run, null where it is absent."""
    return scores(spark, sf_dir).groupBy("fixture").pivot("run", ["click", "view", "purchase"]).agg(F.max("score"))


@query(SCORES + """, p as (select * from s where run = 'view'), n as (select * from s where run = 'click')
select coalesce(n.fixture, p.fixture) as fixture, coalesce(n.status, p.status) as status, n.fixture is null as kept_from_before from p full join n on p.fixture = n.fixture""")
def resume_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses of an earlier run overlaid by those of a new one."""
    s = scores(spark, sf_dir)
    old, new = (s.where(F.col("run") == r).select("fixture", F.col("status").alias(n)) for r, n in (("view", "old"), ("click", "new")))
    return old.join(new, "fixture", "full").select("fixture", F.coalesce("new", "old").alias("status"), F.col("new").isNull().alias("kept_from_before"))


@query(SCORES + "select c_custkey as fixture from customer where c_custkey not in (select fixture from s where run = 'view' and status = 'valid')")
def resume_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is still to do: fixtures without a valid result."""
    done = scores(spark, sf_dir).where((F.col("run") == "view") & (F.col("status") == "valid")).select("fixture")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("fixture")).join(done, "fixture", "left_anti")


@query(ROWS + """select run, round(min(value), 6) as min_extent, round(median(value), 6) as median_extent, round(max(value), 6) as max_extent, round(stddev_pop(value) / avg(value), 6) as cov, round(count(*) filter (value between 180 and 220) / count(*), 6) as share_collapsed from r group by run""")
def scale_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rows(spark, sf_dir)
    v = F.col("value")
    main = r.groupBy("run").agg(F.round(F.min(v), 6).alias("min_extent"), F.round(F.max(v), 6).alias("max_extent"), F.round(F.stddev_pop(v) / F.avg(v), 6).alias("cov"), F.round(F.count_if(v.between(180, 220)) / F.count("*"), 6).alias("share_collapsed"))
    h = stats.histogram(r, ["run"], "value").groupBy("run").agg(F.round(stats.true_median("value"), 6).alias("median_extent"))
    return main.join(h, "run")


@query(ROWS + "select case when error_type = 'timeout' then 'Kernel:timeout' when error_type = 'crash' and value < 100 then 'Kernel:small' when error_type = 'crash' then 'Kernel:crash' when iou is null then 'unscored' else 'scored' end as mode, count(*) as n, round(100 * count(*) / (select count(*) from r), 4) as pct from r group by 1")
def failure_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and shares of ordered failure categories; the total is summed up from the counts."""
    e = F.col("error_type")
    mode = rules.first_of({"Kernel:timeout": e == "timeout", "Kernel:small": (e == "crash") & (F.col("value") < 100), "Kernel:crash": e == "crash", "unscored": F.col("iou").isNull()}, "scored")
    c = rows(spark, sf_dir).groupBy(mode.alias("mode")).agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n").alias("_all"))
    return c.join(F.broadcast(total)).select("mode", "n", F.round(100 * F.col("n") / F.col("_all"), 4).alias("pct"))


@query(ROWS + "select run, count(*) filter (run || ' ' || error_type like 'click %') as n_click, count(*) filter (error_type like 'ok%') as n_ok, count(*) filter (error_type not like 'ok%') as n_skip from r group by run")
def status_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rows(spark, sf_dir).withColumn("line", F.concat_ws(" ", "run", "error_type"))
    return r.groupBy("run").agg(F.count_if(F.col("line").startswith("click ")).alias("n_click"), F.count_if(F.col("error_type").startswith("ok")).alias("n_ok"), F.count_if(~F.col("error_type").startswith("ok")).alias("n_skip"))


@query(ROWS + """select run, round(coalesce(count(*) filter (iou >= 0.5 and k >= 50) / nullif(count(*) filter (iou >= 0.5), 0), 0), 3) as precision, round(coalesce(count(*) filter (iou >= 0.5 and k >= 50) / nullif(count(*) filter (k >= 50), 0), 0), 3) as recall from r group by run""")
def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rows(spark, sf_dir)
    good, true = F.col("iou") >= 0.5, F.col("k") >= 50
    c = r.groupBy("run").agg(F.count_if(good & true).alias("tp"), F.count_if(good).alias("np"), F.count_if(true).alias("nt"))
    m = stats.precision_recall(F.col("tp"), F.col("np"), F.col("nt"))
    return c.select("run", m["precision"].alias("precision"), m["recall"].alias("recall"))
