"""Samples that match target category proportions.

Records of a category are ranked at random; rank r of a category with target share t has priority (r - 0.5) / t, and
the sample is the n records of smallest priority, those within a category's minimum before all others. That is
Webster's divisor method, so shares are met as nearly as whole records allow, and the seats a category can't fill go to
the others by themselves.

Random ranks don't need a category in one task: records fall into hash ranges, a small table of counts per range gives
each range its first rank, and only a range is sorted. The n-th smallest priority follows from the categories' largest
ranks, and every record's own priority is compared with it, so nothing is sorted globally.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skarn.llm.text import hash60
from skarn.session import cut

#: Hash ranges per category.
RANGES = 4096


def random_rank(df: DataFrame, category: str, order: Column, ranges: int = RANGES) -> DataFrame:
    """``df`` with ``rank``: 1, 2, ... within ``category`` by ``order`` (a long spread evenly over its range)."""
    shift = 64 - (ranges - 1).bit_length()
    x = df.withColumn("__o", order).withColumn("__range", F.shiftright("__o", shift) if ranges > 1 else F.lit(0).cast("long"))
    counts = x.groupBy(category, "__range").agg(F.count(F.lit(1)).alias("n"))  # at most categories x ranges rows
    w = Window.partitionBy(category).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(category, "__range", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy(category, "__range").orderBy("__o", *[c for c in df.columns if c != category]))
    return x.withColumn("__in", within).join(starts, [category, "__range"]).withColumn("rank", F.col("__before") + F.col("__in")).drop("__o", "__range", "__in", "__before")


def seats_by_priority(available: list[int], share: list[float], floor: list[int], n: int) -> list[int]:
    """Seats per category when the n smallest priorities are kept, those of rank up to the floor first.

    Equal priorities fall to the category that comes first.
    """
    k = len(available)
    floor = [min(max(f or 0, 0), a) for f, a in zip(floor, available)]
    share = [s if s and s > 0 else 0.0 for s in share]
    available = [a if s else f for a, s, f in zip(available, share, floor)]  # no target, no seat beyond the floor
    p = lambda i, r: (r - 0.5) / share[i] if share[i] else math.inf

    def take(low: list[int], high: list[int], n: int) -> list[int]:
        """Of ranks low+1..high per category, the n of smallest priority."""
        if sum(high) - sum(low) <= n:
            return high
        at_most = lambda x: [lo if not share[i] and x < math.inf else min(hi, max(lo, math.floor(x * share[i] + 0.5) if x < math.inf else hi)) for i, (lo, hi) in enumerate(zip(low, high))]
        a, b = 0.0, max((p(i, high[i]) for i in range(k) if share[i]), default=0.0)
        for _ in range(200):
            m = (a + b) / 2
            a, b = (m, b) if sum(at_most(m)) - sum(low) < n else (a, m)
        got = at_most(a)
        while sum(got) - sum(low) > n:  # rounding may let a last seat in
            i = max((i for i in range(k) if got[i] > low[i]), key=lambda i: (p(i, got[i]), i))
            got[i] -= 1
        while sum(got) - sum(low) < n:
            i = min((i for i in range(k) if got[i] < high[i]), key=lambda i: (p(i, got[i] + 1), i))
            got[i] += 1
        while True:  # of equal or nearly equal priorities the first must have won
            last = max(((p(i, got[i]), i) for i in range(k) if got[i] > low[i]), default=None)
            first = min(((p(i, got[i] + 1), i) for i in range(k) if got[i] < high[i]), default=None)
            if last is None or first is None or last <= first:
                return got
            got[last[1]] -= 1
            got[first[1]] += 1

    first = take([0] * k, floor, n)
    return take(first, available, n - sum(first)) if sum(first) < n else first


def proportional_sample(
    df: DataFrame, record_id: str, category: Column, targets: DataFrame, group: Column | None = None, max_per_group: int | None = None, n: int = 0, seed: int = 0
) -> tuple[DataFrame, DataFrame]:
    """(sample, report).

    ``targets``: category, target_share, min_rows and, if categories differ in it, max_per_group (``max_per_group`` is then
    the largest); one row per category (the largest counts if repeated). The sample has record id and category; at most ``max_per_group`` records of a ``group`` in a category; one row per distinct
    ``record_id``. Records with a null id, a null group or a category that isn't a target don't count. A record whose rows
    name several categories or groups counts in the least (category, group). The report has per target: category,
    target_share, min_rows, available, wanted (the larger of the minimum and the unrounded share of n), seats, reached
    (share of the sample) and short (available < wanted). Null shares and minima count as 0. An empty table gives an
    empty sample and a report of zeros; other columns of ``df`` are dropped.
    """
    g = group if group is not None else F.lit("")
    one = (
        df.select(F.col(record_id).cast("string").alias("id"), category.alias("category"), g.alias("g"))
        .where("id is not null and category is not null and g is not null")
        .groupBy("id").agg(F.min(F.struct("category", "g")).alias("x")).select("id", "x.category", "x.g")
    )
    t = targets.where("category is not null").groupBy("category").agg(F.max(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("min_rows", F.lit(0))).alias("min_rows"))
    if "max_per_group" in targets.columns:
        caps = targets.where("category is not null").groupBy("category").agg(F.max("max_per_group").alias("cap"))
        t = t.join(caps, "category")
    else:
        t = t.withColumn("cap", F.lit(None).cast("long"))
    one = one.join(t.select("category", "cap"), "category")
    order = hash60("id", seed)
    if max_per_group is not None:
        # a limit on row_number is applied before the shuffle too, so a hot group sends few rows
        w = Window.partitionBy("category", "g").orderBy(order, "id")
        one = one.withColumn("in_group", F.row_number().over(w)).where(F.col("in_group") <= max_per_group).where("cap is null or in_group <= cap").drop("in_group")
    ranked = cut(random_rank(one.select("id", "category", "g"), "category", (order - F.lit(1 << 59)) * 16))
    counts = ranked.groupBy("category").agg(F.max("rank").alias("available"))
    stats = t.join(counts, "category", "left").select("category", "target_share", "min_rows", F.coalesce("available", F.lit(0)).alias("available"))

    def seat(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("category")
        seats = seats_by_priority(pdf["available"].tolist(), pdf["target_share"].tolist(), pdf["min_rows"].tolist(), n)
        rows = zip(seats, pdf["min_rows"], pdf["target_share"], pdf["category"])
        late, priority, category = max(((int(r > f), (r - 0.5) / s if s > 0 else math.inf, c) for r, f, s, c in rows if r), default=(-1, 0.0, ""))
        return pdf.assign(last_late=late, last_priority=priority, last_category=category).drop(columns="all")

    stats = cut(stats.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(seat, "category string, target_share double, min_rows long, available long, last_late int, last_priority double, last_category string"))
    share = F.col("target_share")
    ordered = ranked.join(stats, "category").withColumns({
        "late": F.when(F.col("rank") <= F.col("min_rows"), F.lit(0)).otherwise(F.lit(1)),
        "priority": F.when(share > 0, (F.col("rank") - 0.5) / share).otherwise(F.lit(math.inf)),
    }).where("late = 0 or target_share > 0")
    # the floor's records come before all others; no category has a seat beyond it without a target
    within = F.struct("late", "priority", "category") <= F.struct("last_late", "last_priority", "last_category")
    sample = ordered.where(within).select("id", "category", "g", "rank", "priority")
    kept = sample.groupBy("category").agg(F.count(F.lit(1)).alias("seats"))
    wanted = F.greatest(F.col("min_rows").cast("double"), F.col("target_share") * F.lit(n))
    report = stats.drop("last_late", "last_priority", "last_category").join(kept, "category", "left").withColumn("seats", F.coalesce("seats", F.lit(0)))
    report = report.withColumns({"wanted": wanted, "reached": F.col("seats") / F.nullif(F.sum("seats").over(Window.partitionBy(F.lit(0))), F.lit(0)), "short": F.col("available") < wanted})
    return sample.withColumnRenamed("id", record_id), report
