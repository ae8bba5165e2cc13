"""Streaming counts, an extension: batch is the model everywhere else."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_counts(events: DataFrame, ts: str, key: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window_start, key, n, total per tumbling window; rows later than the watermark are dropped by the stream.

    Works on a batch too, where the watermark has no effect. Null times belong to no window; null keys are a key.
    """
    x = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    return x.groupBy(F.window("__ts", width).alias("w"), F.col(key)).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), key, "n", "total")


def first_deliveries(events: DataFrame, ts: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """Rows delivered again within the watermark are dropped."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
