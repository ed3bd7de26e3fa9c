"""Sinks that count while they write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def write_counted(df: DataFrame, path: str, counters: dict[str, Column], *, keep: Column | None = None, format: str = "parquet") -> dict[str, int]:
    """Writes the rows that ``keep`` holds for (null: not; without it all) and returns how many rows each counter holds for, of all rows, zeros left out.

    The counters are gathered by the pass that writes: df is read once.
    """
    seen = Observation()
    # What keep asks is worked out above the counters, which a filter would otherwise be pushed below.
    watched = df.observe(seen, F.count("*").alias("_rows"), *[F.count_if(c).alias(k) for k, c in counters.items()])
    rows = watched if keep is None else watched.where(F.coalesce(keep, F.lit(False)))
    rows.write.format(format).mode("overwrite").save(path)
    return {k: v for k, v in seen.get.items() if k != "_rows" and v}
