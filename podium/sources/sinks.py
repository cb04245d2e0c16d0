"""Writing reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_event_reports(parts: DataFrame, path: str, buckets: int = 64) -> None:
    """Write report parts as JSON lines, one folder per bucket of events.

    Folders per event would make as many small files as there are events. The rebalance hint gathers a
    bucket for writing and lets AQE split the bucket of a very large event over several tasks.
    """
    (
        parts.withColumn("event_bucket", F.pmod(F.xxhash64("event_id"), F.lit(buckets)).cast("int"))
        .hint("rebalance", "event_bucket")
        .write.mode("errorifexists")
        .partitionBy("event_bucket")
        .json(path)
    )
