"""Where intermediate tables go: the shared folder that the cluster names, by the library's own helper."""

from __future__ import annotations

from pyspark.sql import DataFrame

from plateworks.shared import mark, release, shared_dir, written

__all__ = ["checkpointed", "mark", "release", "shared_dir", "written"]


def checkpointed(df: DataFrame) -> DataFrame:
    """df.checkpoint() in the shared folder. Its files go with the last reference if spark.cleaner.referenceTracking.cleanCheckpoints is true, else with the folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
