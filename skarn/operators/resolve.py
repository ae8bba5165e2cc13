"""Entity resolution: dated identifier joins, interval joins, first match, unmatched rows.

Date-range joins are made equi-joins: a range of at most w days lies in at most two buckets of w days, so each left row
is filed in the buckets its range touches and the join runs on (key, bucket) with the range as a residual. A key with
many rows is thereby spread over its days.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def forward_range_join(left: DataFrame, right: DataFrame, on: list[str], day: str, right_day: str, days: int = 7) -> DataFrame:
    """Pairs with equal ``on`` columns and right_day within [day, day + days]. Null or blank keys match nothing.

    ``on`` columns appear once; other columns must differ in name.
    """
    width = days + 1
    full = lambda df: reduce(lambda d, c: d.where(F.col(c).isNotNull() & (F.col(c).cast("string") != "")), on, df)
    bucket = lambda c: F.floor(F.unix_date(c) / F.lit(width)).cast("long")
    a = full(left).withColumn("__b", F.explode(F.array_distinct(F.array(bucket(F.col(day)), bucket(F.date_add(day, days))))))
    b = full(right).withColumn("__b", bucket(F.col(right_day)))
    return a.join(b, [*on, "__b"]).where((F.col(right_day) >= F.col(day)) & (F.datediff(right_day, day) <= days)).drop("__b")


#: Days in a bucket that intervals are filed in.
INTERVAL_DAYS = 1024


def interval_join(left: DataFrame, right: DataFrame, on: list[str], day: str, first: str, last: str) -> DataFrame:
    """Pairs with equal ``on`` columns and day within [first, last]; a null last is open. Both edges count.

    Intervals are filed in every bucket of days they touch, within the buckets that hold a day at all, and the join runs on
    (key, bucket), so a key with many rows is spread over its days. Null keys and days match nothing.
    """
    bucket = lambda c: F.floor(F.unix_date(c) / F.lit(INTERVAL_DAYS)).cast("long")
    a = left.where(F.col(day).isNotNull()).withColumn("__b", bucket(F.col(day)))
    ends = left.agg(F.min(day).alias("a"), F.max(day).alias("b")).select(bucket(F.col("a")).alias("a"), bucket(F.col("b")).alias("b")).first()  # two numbers
    if ends["a"] is None:
        ends = {"a": 0, "b": -1}
    span = {"__f": F.greatest(bucket(F.col(first)), F.lit(ends["a"])), "__l": F.least(F.coalesce(bucket(F.col(last)), F.lit(ends["b"])), F.lit(ends["b"]))}
    b = right.where(F.col(first).isNotNull()).withColumns(span).where("__f <= __l").withColumn("__b", F.explode(F.sequence("__f", "__l"))).drop("__f", "__l")
    return a.join(b, [*on, "__b"]).where((F.col(day) >= F.col(first)) & (F.col(last).isNull() | (F.col(day) <= F.col(last)))).drop("__b")


def union_all(frames: list[DataFrame], missing: bool = False) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=missing), frames)


def event_keys(events: DataFrame, event_id: str, day: str, keys: dict[str, tuple[Column, float]]) -> DataFrame:
    """Long form of an event's identifiers: event_id, event_day, key_type, key, confidence; null and blank keys dropped.

    ``keys``: key type -> (identifier, confidence).
    """
    rows = F.array(*[F.struct(F.lit(k).alias("key_type"), c.cast("string").alias("key"), F.lit(conf).alias("confidence")) for k, (c, conf) in keys.items()])
    return events.select(F.col(event_id).alias("event_id"), F.col(day).alias("event_day"), F.inline(rows)).where("key is not null and trim(key) <> ''")


def security_keys(daily: DataFrame, security: str, day: str, keys: dict[str, Column]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(k).alias("key_type"), c.cast("string").alias("key")) for k, c in keys.items()])
    return daily.select(F.col(security).alias("security"), F.col(day).alias("trade_day"), F.inline(rows)).where("key is not null and trim(key) <> ''").distinct()


def resolve_first(ev_keys: DataFrame, sec_keys: DataFrame, days: int = 7) -> DataFrame:
    """Per event the best candidate: highest confidence, then the earliest day, then the least security.

    One narrow join over all identifier types instead of one wide join each; the choice is a partial aggregate.
    """
    pairs = forward_range_join(ev_keys, sec_keys, ["key_type", "key"], "event_day", "trade_day", days)
    best = F.min(F.struct((-F.col("confidence")).alias("c"), "trade_day", "security", "key_type")).alias("b")
    return pairs.groupBy("event_id").agg(best).select("event_id", F.col("b.security").alias("security"), F.col("b.trade_day").alias("anchor_day"), F.col("b.key_type").alias("join_method"), (-F.col("b.c")).alias("join_confidence"))


def with_resolution(events: DataFrame, event_id: str, resolved: DataFrame) -> DataFrame:
    """Every event with its match, or join_method 'none', confidence 0 and status 'unmatched'."""
    r = resolved.withColumnRenamed("event_id", "__id")
    x = events.join(r, F.col(event_id) == F.col("__id"), "left").drop("__id")
    return x.withColumns({"join_status": F.when(F.col("join_method").isNull(), "unmatched").otherwise("matched"), "join_method": F.coalesce("join_method", F.lit("none")), "join_confidence": F.coalesce("join_confidence", F.lit(0.0))})


def unmatched(events: DataFrame, matched: DataFrame, on: str) -> DataFrame:
    return events.join(matched.select(on), on, "left_anti")


def method_distribution(panel: DataFrame) -> DataFrame:
    return panel.groupBy("join_status", "join_method").agg(F.count(F.lit(1)).alias("n"))


def lookup(df: DataFrame, dim: DataFrame, on: str, required: bool = False) -> DataFrame:
    """``df`` with the columns of ``dim``, whose ``on`` must be unique; with ``required`` a key without an entry is an error."""
    if required and (gone := [r[0] for r in unmatched(df.where(F.col(on).isNotNull()), dim, on).select(on).distinct().limit(5).collect()]):
        raise KeyError(f"no entry for {on}: {', '.join(map(str, gone))}")
    return df.join(dim, on, "left")
