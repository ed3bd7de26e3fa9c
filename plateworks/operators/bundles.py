"""Bundles of records in several variants, split for training and validation, and written with their statistics."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plateworks.shared import shared_dir, written


def variants(df: DataFrame, name: str, which: Mapping[str, Column], *, order: Sequence[str], share: float) -> DataFrame:
    """A row for each record and variant that it has, with ``variant``, ``file_name`` (name__variant) and ``split``.

    In the order of ``order`` and then of the variants, the first ``share`` of all rows, at least one, is val and the others train; a share of 0 makes
    all of them both (split is then both). Variants whose condition is null are not there. Rows are ordered by range, and only counts of ranges meet.
    """
    each = F.filter(F.array(*[F.when(c, F.struct(F.lit(i).alias("v"), F.lit(n).alias("variant"))) for i, (n, c) in enumerate(which.items())]), lambda x: x.isNotNull())
    rows = df.withColumn("_x", F.explode(each)).select("*", F.col("_x.variant").alias("variant"), F.col("_x.v").alias("_v"), F.concat(F.col(name), F.lit("__"), F.col("_x.variant")).alias("file_name")).drop("_x")
    if share <= 0:
        return rows.drop("_v").withColumn("split", F.lit("both"))
    by = [*order, "_v"]
    ranged = written(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()), "ranged")
    parts = ranged.groupBy("_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_k"))  # a row a range
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", "_first", F.coalesce(F.sum("_k").over(upto), F.lit(0)).alias("_before"), F.sum("_k").over(Window.partitionBy()).alias("_total"))
    placed = ranged.join(F.broadcast(parts), "_part").withColumn("_n", F.col("_at") - F.col("_first") + F.col("_before") + 1)
    split = F.when(F.col("_n") <= F.greatest(F.lit(1), F.floor(F.col("_total") * share)), "val").otherwise("train")
    return placed.withColumn("split", split).drop("_part", "_at", "_first", "_before", "_total", "_n", "_v")


def new_folder(spark: SparkSession) -> str:
    """A new place in the shared folder."""
    return f"{shared_dir(spark)}/plateworks-bundle-{uuid.uuid4().hex}"


def write_bundle(rows: DataFrame, folder: str, chars: Column) -> DataFrame:
    """Writes rows as JSON lines by split and variant in one pass, and returns split, variant, n, min, max and mean (whole) of ``chars`` of what was written; no rows give none."""
    rows.withColumn("_chars", chars.cast("long")).write.partitionBy("split", "variant").json(folder)
    back = rows.sparkSession.read.schema("_chars long, split string, variant string").json(folder)
    return back.groupBy("split", "variant").agg(F.count("*").alias("n"), F.min("_chars").alias("min"), F.max("_chars").alias("max"), F.expr("sum(_chars) div count(1)").alias("mean"))
