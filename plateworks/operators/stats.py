"""Distribution statistics by rank, rates and coverage.

Ranks come from histograms: rows are counted by (group, value) before anything is ordered, so that a group of any size is
pre-aggregated map-side and the running sum meets each distinct value once. Continuous values, of which few are equal, are ordered
in slices of value with an offset each, so that no task holds a whole group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plateworks.operators import selection
from plateworks.shared import written


def histogram(df: DataFrame, by: Sequence[str], value: str, spread: bool = True) -> DataFrame:
    """(by, value, _n, _upto, _total): rows with each value, up to it, and in the group; nulls are left out.

    Groups of any size are ordered slice by slice; ``spread=False`` is for groups that stay small, such as one drawing.
    """
    return ranked(df.groupBy(*by, value).agg(F.count("*").alias("_n")), by, value, spread)


def ranked(counted: DataFrame, by: Sequence[str], value: str, spread: bool = True) -> DataFrame:
    """As histogram(), of values that are counted already: (by, value, _n), one row for each value.

    Spread counts are written to the shared folder, as the offsets of slices are an aggregate of the same table: what is above is worked out once.
    """
    counted = counted.where(F.col(value).isNotNull()).select(*by, value, "_n")
    group = Window.partitionBy(*by)
    if not spread:
        upto = group.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return counted.withColumn("_upto", F.sum("_n").over(upto)).withColumn("_total", F.sum("_n").over(group))
    d = selection.with_offsets(written(counted.withColumn("_part", selection.slice_of(F.col(value))), "histogram"), by, "_part", F.sum("_n"))
    upto = Window.partitionBy(*by, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return d.withColumn("_upto", F.col("_before") + F.sum("_n").over(upto)).drop("_part", "_before")


def at_rank(value: str, index: Column) -> Column:
    """Aggregate over a histogram: the value at a 0-based index of the sorted rows."""
    return F.min(F.when(F.col("_upto") > index, F.col(value)))


def floor_index(q: float) -> Column:
    """min(n - 1, floor(q / 100 * n))."""
    return F.least(F.col("_total") - 1, F.floor(F.lit(q / 100) * F.col("_total")))


def round_index(q: float) -> Column:
    """round((n - 1) * q / 100), halves to even."""
    return F.rint((F.col("_total") - 1) * F.lit(q / 100))


def plain_floor_index(q: float) -> Column:
    """floor(q / 100 * n), which may lie past the end for q = 100."""
    return F.floor(F.lit(q / 100) * F.col("_total"))


def true_median(value: str) -> Column:
    """The mean of the middle one or two."""
    low, high = F.floor((F.col("_total") - 1) / 2), F.floor(F.col("_total") / 2)
    return (at_rank(value, low) + at_rank(value, high)) / 2


def distribution(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """by, n, min, median (truncated), mean (1 decimal), p90, p95, p99, max: the floor form of percentiles."""
    return described(histogram(df, by, value), by, value)


def described(h: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """The same of a histogram."""
    mean = F.sum(F.col(value) * F.col("_n")) / F.sum("_n")
    ranks = {f"p{q}": at_rank(value, floor_index(q)) for q in (90, 95, 99)}
    return h.groupBy(*by).agg(
        F.sum("_n").alias("n"),
        F.min(value).alias("min"),
        F.floor(true_median(value)).cast("long").alias("median"),
        F.round(mean, 1).alias("mean"),
        *[c.alias(k) for k, c in ranks.items()],
        F.max(value).alias("max"),
    )


def finite_distribution(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """by, p50, p90, p99, max of the finite values and n_nonfinite; a group without finite values keeps nulls."""
    v = F.col(value)
    odd = F.isnan(v) | (F.abs(v) == float("inf"))
    counts = df.groupBy(*by).agg(F.count_if(odd).alias("n_nonfinite"))
    h = histogram(df.where(~odd), by, value)
    d = h.groupBy(*by).agg(*[at_rank(value, floor_index(q)).alias(f"p{q}") for q in (50, 90, 99)], F.max(value).alias("max"))
    return counts.join(d, list(by), "left")


def quartiles_rounded(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """by, min, p25, median, p75, max with half-even rounded indexes."""
    h = histogram(df, by, value)
    return h.groupBy(*by).agg(F.min(value).alias("min"), *[at_rank(value, round_index(q)).alias(n) for n, q in (("p25", 25), ("median", 50), ("p75", 75))], F.max(value).alias("max"))


def cap_coverage(df: DataFrame, total: str, caps: Sequence[int], extra: int = 40) -> DataFrame:
    """cap, pairs_over, pct_over, pairs_kept. One pass: each cap is an aggregate, then a row."""
    over = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(total) + extra > c).alias(f"c{c}") for c in caps])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("cap"), F.col(f"c{c}").alias("pairs_over")) for c in caps]))
    r = over.select("n", rows.alias("r")).select("n", "r.cap", "r.pairs_over")
    return r.select("cap", "pairs_over", F.round(100 * F.col("pairs_over") / F.col("n"), 1).alias("pct_over"), (F.col("n") - F.col("pairs_over")).alias("pairs_kept"))


def exceedance(df: DataFrame, by: Sequence[str], value: str, thresholds: Sequence[float]) -> DataFrame:
    """by, threshold, n_above."""
    counted = df.groupBy(*by).agg(*[F.count_if(F.col(value) > t).alias(f"t{i}") for i, t in enumerate(thresholds)])
    rows = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{i}").alias("n_above")) for i, t in enumerate(thresholds)]))
    return counted.select(*by, rows.alias("r")).select(*by, "r.threshold", "r.n_above")


def error_histogram(df: DataFrame, by: Sequence[str], error: str, ordinal: str) -> DataFrame:
    """by, error, n, place: by falling count, the first seen first among equals."""
    counted = df.groupBy(*by, error).agg(F.count("*").alias("n"), F.min(ordinal).alias("_first"))
    order = Window.partitionBy(*by).orderBy(F.desc("n"), "_first")
    return counted.withColumn("place", F.row_number().over(order)).drop("_first")


def precision_recall(tp: Column, n_pred: Column, n_true: Column) -> Mapping[str, Column]:
    """precision, recall and f1 to 3 decimals; 0 where a denominator is 0."""
    safe = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    p, r = safe(tp, n_pred), safe(tp, n_true)
    f1 = F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0))
    return {"precision": F.round(p, 3), "recall": F.round(r, 3), "f1": F.round(f1, 3)}
