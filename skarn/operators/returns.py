"""Trading-day indices and event-window returns.

A window's return is computed once per daily row, as a running sum over a frame of trading days, and events pick it up
by an equi-join on (security, index); no event is joined with a range of days.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Returns at or below this lose everything and have no logarithm.
FLOOR = -0.999999


def parse_window(spec: str) -> tuple[int, int]:
    """'start:end' in trading days, start <= end."""
    m = re.fullmatch(r"\s*([+-]?\d+)\s*:\s*([+-]?\d+)\s*", spec)
    if not m:
        raise ValueError(f"window {spec!r} isn't start:end with whole numbers")
    s, e = int(m[1]), int(m[2])
    if s > e:
        raise ValueError(f"window {spec!r} starts after its end")
    return s, e


def window_slug(spec: str) -> str:
    """'-1:5' -> 'w_m1_p5'."""
    return "w_" + "_".join(f"{'m' if x < 0 else 'p'}{abs(x)}" for x in parse_window(spec))


def trade_index(daily: DataFrame, security: str, order: list[Column]) -> DataFrame:
    """Adds trade_idx, 1, 2, ... per security; it counts rows, so rows without a return should be dropped first."""
    return daily.withColumn("trade_idx", F.row_number().over(Window.partitionBy(security).orderBy(*order)))


def _compound(ret: Column, w) -> Column:
    ok = ret > FLOOR
    return F.when(F.count_if(ok).over(w) > 0, F.exp(F.sum(F.when(ok, F.log1p(ret))).over(w)) - 1)


def window_returns(daily: DataFrame, security: str, windows: list[str], ret: str = "ret", benchmark: str | None = None) -> DataFrame:
    """Adds, per window, raw_return, obs_count and, with a benchmark column, benchmark_return and abnormal_return.

    Returns are compounded over rows with a value above FLOOR and null without any; obs_count counts non-null values;
    the benchmark has its own validity; the abnormal return is null if either part is.
    """
    out = daily
    for spec in windows:
        s, e = parse_window(spec)
        w = Window.partitionBy(security).orderBy("trade_idx").rowsBetween(s, e)
        n = window_slug(spec)
        cols = {f"raw_return_{n}": _compound(F.col(ret), w), f"obs_count_{n}": F.count(ret).over(w)}
        if benchmark:
            cols[f"benchmark_return_{n}"] = _compound(F.col(benchmark), w)
        out = out.withColumns(cols)
    if benchmark:
        out = out.withColumns({f"abnormal_return_{window_slug(x)}": F.col(f"raw_return_{window_slug(x)}") - F.col(f"benchmark_return_{window_slug(x)}") for x in windows})
    return out


def label_alignment(df: DataFrame, label: str, ret: str) -> DataFrame:
    """Per label: events, mean return and hit rate (share of returns on the label's side; null for other labels)."""
    hit = F.when(F.col(label) == "positive", F.col(ret) > 0).when(F.col(label) == "negative", F.col(ret) < 0)
    return df.where(F.col(ret).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("events"), F.avg(ret).alias("mean_return"), F.avg(hit.cast("double")).alias("hit_rate"))


def long_short_spread(df: DataFrame, label: str, ret: str) -> DataFrame:
    """One row: mean return of positive and of negative labels, and their difference."""
    side = lambda v: F.avg(F.when(F.col(label) == v, F.col(ret)))
    return df.agg(side("positive").alias("long_return"), side("negative").alias("short_return"), (side("positive") - side("negative")).alias("spread"))
