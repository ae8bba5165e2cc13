"""Deduplication, consensus aggregation and change labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skarn.functions.clean import direction_label, magnitude_bucket, pct_change


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first by ``order``, which should be total; then the survivor doesn't depend on the layout.

    Null key values form a key of their own. The limit runs before the shuffle too, so a hot key sends one row per task.
    """
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def dedup_stats(df: DataFrame, keys: list[str]) -> DataFrame:
    """rows_in, rows_out, duplicates_removed in two partial aggregations."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"))
    n = F.coalesce(F.sum("c"), F.lit(0))
    return g.agg(n.alias("rows_in"), F.count(F.lit(1)).alias("rows_out"), (n - F.count(F.lit(1))).alias("duplicates_removed"))


def consensus(df: DataFrame, keys: list[str], value: str, analyst: str, estimator: str, first_of: list[str]) -> DataFrame:
    """Per key: counts, mean, median (the lower of two), sample deviation, extremes and the least of the dates.

    The median is percentile_approx with its default accuracy: exact up to 10,000 values a key, mergeable beyond. Distinct
    counts are aggregated apart and joined on the keys: beside a sketch they would carry it through every row they expand
    to. Both sides are partitioned by the keys (as one struct, so null keys meet), so the join moves nothing.
    """
    key = F.struct(*keys).alias("__k")
    figures = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("estimate_count"),
        F.avg(value).alias("consensus_mean"),
        F.percentile_approx(value, 0.5).alias("consensus_median"),
        F.stddev_samp(value).alias("consensus_std"),
        F.min(value).alias("consensus_min"),
        F.max(value).alias("consensus_max"),
        *[F.min(c).alias(f"first_{c}") for c in first_of],
    )
    people = df.groupBy(key).agg(F.count_distinct(analyst).alias("analyst_count"), F.count_distinct(estimator).alias("estimator_count"))
    rest = [c for c in figures.columns if c not in ("__k", "estimate_count")]
    return figures.join(people, "__k").select("__k.*", "estimate_count", "analyst_count", "estimator_count", *rest)


def with_change_labels(df: DataFrame, history: list[str], order: list[Column], neutral: float = 0.005) -> DataFrame:
    """Prior median and mean within ``history``, delta, percentage change, direction and magnitude.

    The first event of a history has null changes, direction 'neutral' and magnitude 'unknown'.
    """
    w = Window.partitionBy(*history).orderBy(*order)
    x = df.withColumns({"prior_consensus_median": F.lag("consensus_median").over(w), "prior_consensus_mean": F.lag("consensus_mean").over(w)})
    x = x.withColumn("consensus_delta", F.col("consensus_median") - F.col("prior_consensus_median"))
    x = x.withColumn("consensus_pct_change", pct_change(F.col("consensus_delta"), F.col("prior_consensus_median")))
    return x.withColumns({"direction_label": direction_label(F.col("consensus_delta"), neutral), "magnitude_bucket": magnitude_bucket(F.col("consensus_delta"), F.col("consensus_pct_change"), neutral)})


def label_counts(df: DataFrame) -> DataFrame:
    one = lambda v: F.count_if(F.col("direction_label") == v)
    return df.agg(F.count(F.lit(1)).alias("event_rows"), F.count("prior_consensus_median").alias("rows_with_prior"), one("positive").alias("positive_labels"), one("negative").alias("negative_labels"), one("neutral").alias("neutral_labels"))
