"""Keys, sets, limits and sampling."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stem(path: Column) -> Column:
    """The key of a file: its name without .graph.json, .json, or else its last extension."""
    name = F.element_at(F.split(path, "/"), -1)
    known = F.regexp_replace(name, r"\.graph\.json$", "")
    known = F.when(known == name, F.regexp_replace(name, r"\.json$", "")).otherwise(known)
    return F.when(known == name, F.regexp_replace(name, r"(.)\.[^.]*$", "$1")).otherwise(known)


def draw(key: Column, seed: int) -> Column:
    """A hash that orders rows for sampling: the same everywhere, unlike a random number."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def common(*sides: DataFrame) -> DataFrame:
    """Ids that all sides have."""
    out = sides[0]
    for side in sides[1:]:
        out = out.intersect(side)
    return out


def log_edges(low: float, high: float, bins: int) -> list[int]:
    """Interior edges of log-spaced bins, rounded and distinct."""
    ratio = (high / low) ** (1 / bins)
    edges = [round(low * ratio**i) for i in range(1, bins)]
    return sorted({e for e in edges if low < e < high})


def bin_of(value: Column, edges: Sequence[float]) -> Column:
    """The number of edges at or below the value."""
    return sum(((value >= e).cast("int") for e in edges), F.lit(0))


def water_fill(pools: DataFrame, by: Sequence[str], ordinal: str, pool: str, wanted: Column) -> DataFrame:
    """pools with alloc: equal shares of ``wanted`` capped by each pool, what is over shared again, the remainder to the lowest open ordinals.

    Bins by size of their pool: one is open if its pool, for all bins left, is over what is left. All later ones are open then.
    """
    group = Window.partitionBy(*by)
    order = group.orderBy(pool, ordinal)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    p = pools.withColumn("_want", wanted.cast("long")).withColumn("_left", F.col("_want") - F.coalesce(F.sum(pool).over(before), F.lit(0)))
    p = p.withColumn("_bins", F.count("*").over(group) - F.row_number().over(order) + 1)
    p = p.withColumn("_open", F.max((F.col(pool) * F.col("_bins") > F.col("_left")).cast("int")).over(upto) == 1)
    capped = F.sum(F.when(F.col("_open"), 0).otherwise(F.col(pool))).over(group)
    p = p.withColumn("_rem", F.col("_want") - capped).withColumn("_k", F.sum(F.col("_open").cast("long")).over(group))
    nth = F.sum(F.col("_open").cast("long")).over(group.orderBy(ordinal).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    p = p.withColumn("_nth", nth)
    share = F.floor(F.col("_rem") / F.col("_k")) + (F.col("_nth") <= F.col("_rem") % F.col("_k")).cast("long")
    return p.withColumn("alloc", F.when(F.col("_open"), share).otherwise(F.col(pool)).cast("long")).drop("_want", "_left", "_bins", "_open", "_rem", "_k", "_nth")


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], name: str = "n") -> DataFrame:
    """Rows numbered from 1 within each group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def slice_of(value: Column) -> Column:
    """A slice that never falls as the value grows: 1,024 to each doubling, the same for equal values, infinity and NaN with one each."""
    v = value.cast("double")
    return F.rint(F.signum(v) * F.log2(1 + F.abs(v)) * 1024)


def with_offsets(df: DataFrame, by: Sequence[str], part: str, rows: Column) -> DataFrame:
    """df with _before and _total: rows of the group in lower slices ``part``, and in all.

    Only the table of slices is ordered in one task for each group; nulls in ``by`` are a group.
    """
    on = [*by, part]
    group = Window.partitionBy(*by)
    lower = group.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    slices = df.groupBy(*on).agg(rows.alias("_rows"))
    slices = slices.select(*[F.col(c).alias(f"_at{i}") for i, c in enumerate(on)], F.coalesce(F.sum("_rows").over(lower), F.lit(0)).alias("_before"), F.sum("_rows").over(group).alias("_total"))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_at{i}")) for i, c in enumerate(on)])
    return df.join(slices, same).drop(*[f"_at{i}" for i in range(len(on))])


def numbered_spread(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], part: Column, name: str = "n") -> DataFrame:
    """As ``numbered`` for groups of any size: ``part``, which must not fall along the order, cuts a group into slices that are sorted apart."""
    d = with_offsets(df.withColumn("_part", part), by, "_part", F.count("*"))
    inside = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order))
    return d.withColumn(name, F.col("_before") + inside).drop("_part", "_before", "_total")


def first_by(df: DataFrame, by: Sequence[str], order: Column, keep: Sequence[str]) -> DataFrame:
    """The row of each group that comes first, by a map-side aggregate."""
    best = df.groupBy(*by).agg(F.min_by(F.struct(*keep), order).alias("_b"))
    return best.select(*by, "_b.*")
