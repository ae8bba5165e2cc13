"""Matching records by nearest time.

Every right-hand time owns the left-hand times that are nearer to it than to its neighbours: an interval bounded by
the midpoints to the neighbours and by the tolerance. The intervals of an entity are disjoint, so nearest match is a
range join with at most one partner. Neighbours further off than twice the tolerance don't move a bound, so they are
sought in slices of time with a margin of that width; no window holds an entity's whole history. The join runs on
(entity, bucket) with buckets about as long as the longest interval, each interval being filed in one or two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Length of a slice, in tolerances.
SLICE_TOLERANCES = 64


def _floor_div(c: Column, n: int) -> Column:
    return F.floor(c / F.lit(n)).cast("long")


def owned_intervals(right: DataFrame, tolerance: int, later_wins: bool = True) -> DataFrame:
    """k, t, lo, hi: the times for which t is the nearest right-hand time of k. ``right``: k, t (long), distinct."""
    width, margin = max(1, SLICE_TOLERANCES * tolerance), 2 * tolerance
    own = _floor_div(F.col("t"), width)
    into = F.array_compact(F.array(own, F.when(F.col("t") - own * width <= margin, own - 1), F.when((own + 1) * width - F.col("t") <= margin, own + 1)))
    w = Window.partitionBy("k", "slice").orderBy("t")
    near = right.withColumns({"own": own, "slice": F.explode(into)}).withColumns({"before": F.lag("t").over(w), "after": F.lead("t").over(w)}).where("slice = own")
    # the first whole time that is nearer to the later of two: at the midpoint itself the later or the earlier wins
    turn = (lambda a, b: F.shiftright(a + b + F.lit(1), 1)) if later_wins else (lambda a, b: F.shiftright(a + b, 1) + 1)
    t = F.col("t")
    return near.select(
        "k", "t",
        F.greatest(t - tolerance, F.coalesce(turn(F.col("before"), t), t - tolerance)).alias("lo"),
        F.least(t + tolerance, F.coalesce(turn(t, F.col("after")) - 1, t + tolerance)).alias("hi"),
    )


def nearest_in_time(
    left: DataFrame, right: DataFrame, *, left_key: Column, left_time: Column, right_key: Column, right_time: Column, tolerance: int, later_wins: bool = True
) -> DataFrame:
    """``left`` rows that have a partner, with ``nearest_time``: the right-hand time of the same key nearest to theirs.

    Times are whole numbers (days, microseconds) of which at most ``tolerance`` may lie between the two. Of two equally
    near times the later wins (the earlier if ``later_wins`` is off). Rows with a null key or time on either side
    match nothing; right-hand rows that repeat a time count once, left-hand rows are kept as often as they occur. Empty
    tables give no rows. All columns of ``left`` pass through; names beginning with two underscores are reserved.
    """
    if tolerance < 0:
        raise ValueError("the tolerance must not be negative")
    r = right.select(right_key.alias("k"), right_time.cast("long").alias("t")).where("k is not null and t is not null").distinct()
    bucket = 2 * tolerance + 1
    index = owned_intervals(r, tolerance, later_wins).withColumn("b", F.explode(F.array_distinct(F.array(_floor_div(F.col("lo"), bucket), _floor_div(F.col("hi"), bucket)))))
    index = index.select(*[F.col(c).alias(f"__i_{c}") for c in index.columns])
    x = left.withColumns({"__k": left_key, "__t": left_time.cast("long")}).where("__k is not null and __t is not null").withColumn("__b", _floor_div(F.col("__t"), bucket))
    hit = (F.col("__k") == F.col("__i_k")) & (F.col("__b") == F.col("__i_b")) & F.col("__t").between(F.col("__i_lo"), F.col("__i_hi"))
    return x.join(index, hit).select(*[F.col(f"`{c}`") for c in left.columns], F.col("__i_t").alias("nearest_time"))
