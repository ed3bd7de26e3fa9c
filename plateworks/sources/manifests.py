"""Small records beside the data: manifests, statistics, and the parameters of a selection."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_manifest(parts: DataFrame, path: str, *, status: str = "status", ok: str = "OK") -> DataFrame:
    """Writes a row of JSON for each part whose stage went well, and returns the counts of the others by status."""
    parts.where(F.col(status) == ok).drop(status).write.mode("overwrite").json(path)
    return parts.where(~F.col(status).eqNullSafe(ok)).groupBy(status).agg(F.count("*").alias("n"))


def manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a manifest. It is an error if there is none, said with its path."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        raise FileNotFoundError(f"no manifest at {path}: build the fixtures first") from e


def write_stats(stats: DataFrame, path: str) -> None:
    """One JSON document of counts and distributions: a DataFrame of one row, nested as needed."""
    stats.coalesce(1).write.mode("overwrite").json(path)


def selection_params(spark: SparkSession, path: str, schema: str) -> dict | None:
    """The parameters that a selection was made with, or None if there are none or they can't be read; never a guess."""
    try:
        rows = spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path).take(2)
    except AnalysisException:
        return None
    if len(rows) != 1 or rows[0]["_bad"] is not None:
        return None
    return {k: v for k, v in rows[0].asDict(recursive=True).items() if k != "_bad"}
