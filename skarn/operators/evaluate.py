"""Classification metrics and run comparisons over prediction tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INVALID = "__invalid__"


def safe_div(a: Column, b: Column) -> Column:
    """a / b; 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(df: DataFrame, keys: list[str], gold: str = "gold", pred: str = "pred") -> DataFrame:
    """keys, gold, pred, n; a null prediction is '__invalid__'."""
    return df.groupBy(*keys, F.col(gold).alias("gold"), F.coalesce(F.col(pred), F.lit(INVALID)).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def _cells(df: DataFrame, keys: list[str], labels: list[str]) -> DataFrame:
    """Per key and known label: tp, fp, fn, support, from the confusion counts.

    A prediction that isn't a known label is wrong, but counts neither as a miss nor in the support; a gold label that
    isn't known counts nowhere.
    """
    c = confusion(df, keys)
    known, counted = F.col("gold").isin(labels), F.col("pred").isin([*labels, INVALID])
    n = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    per = []
    for x in labels:
        g, p = F.col("gold") == x, F.col("pred") == x
        per.append(F.struct(F.lit(x).alias("label"), n(g & p).alias("tp"), n(known & ~g & p).alias("fp"), n(g & counted & ~p).alias("fn"), n(g & counted).alias("support")))
    grouped = c.groupBy(*keys).agg(F.array(*per).alias("cells"))
    return grouped.select(*keys, F.inline("cells"))


def class_metrics(df: DataFrame, keys: list[str], labels: list[str]) -> DataFrame:
    """keys, label, precision, recall, f1, support."""
    p, r = safe_div(F.col("tp"), F.col("tp") + F.col("fp")), safe_div(F.col("tp"), F.col("tp") + F.col("fn"))
    return _cells(df, keys, labels).withColumns({"precision": p, "recall": r}).select(*keys, "label", "precision", "recall", safe_div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"), "support")


def summary_metrics(df: DataFrame, keys: list[str], labels: list[str]) -> DataFrame:
    """keys, sample_count, accuracy, macro_f1 (over all known labels), invalid_count, parse_failure_rate."""
    f1 = class_metrics(df, keys, labels).groupBy(*keys).agg(F.avg("f1").alias("macro_f1"))
    n = F.count(F.lit(1))
    base = df.groupBy(*keys).agg(n.alias("sample_count"), safe_div(F.count_if(F.col("pred") == F.col("gold")), n).alias("accuracy"), F.count_if(F.col("pred").isNull()).alias("invalid_count"), safe_div(F.count_if(F.col("pred").isNull()), n).alias("parse_failure_rate"))
    return base.join(f1, keys) if keys else base.withColumn("macro_f1", f1.scalar())


def rate_summary(df: DataFrame, keys: list[str], flags: dict[str, Column], means: dict[str, Column]) -> DataFrame:
    """Share of rows with each flag (null counts as no) and mean of each measure, in one aggregation."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("sample_count"), *[F.avg(F.coalesce(c, F.lit(False)).cast("double")).alias(k) for k, c in flags.items()], *[F.coalesce(F.avg(c), F.lit(0.0)).alias(k) for k, c in means.items()])


def structured_match(df: DataFrame, keys: list[str], fields: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Share of rows whose fields agree, each and all together; two nulls agree."""
    same = {k: a.eqNullSafe(b) for k, (a, b) in fields.items()}
    every = reduce(lambda a, b: a & b, same.values())
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("sample_count"), F.avg(every.cast("double")).alias("exact_match_rate"), *[F.avg(c.cast("double")).alias(f"{k}_accuracy") for k, c in same.items()])


def compare_runs(a: DataFrame, b: DataFrame, example_id: str) -> DataFrame:
    """Both runs per example: gold, pred_a, pred_b, outcome ('win', 'regression', 'both_right', 'both_wrong')."""
    x = a.select(example_id, F.col("gold"), F.col("pred").alias("pred_a")).join(b.select(example_id, F.col("pred").alias("pred_b")), example_id)
    ra, rb = F.coalesce(F.col("pred_a") == F.col("gold"), F.lit(False)), F.coalesce(F.col("pred_b") == F.col("gold"), F.lit(False))
    return x.withColumn("outcome", F.when(rb & ~ra, "win").when(ra & ~rb, "regression").when(ra & rb, "both_right").otherwise("both_wrong"))


def shift_counts(compared: DataFrame) -> DataFrame:
    """Regressions by change of prediction: shift ('old->new'), n, and how many left a neutral gold for another label."""
    label = lambda c: F.coalesce(F.col(c), F.lit("None"))
    reg = compared.where("outcome = 'regression'")
    return reg.groupBy(F.concat(label("pred_a"), F.lit("->"), label("pred_b")).alias("shift")).agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("gold") == "neutral") & F.col("pred_b").isin("positive", "negative")).alias("neutral_overcalls"))


def metric_deltas(metrics: DataFrame, keys: list[str], variant: str, base: str, other: str, names: list[str]) -> DataFrame:
    """keys, delta_<name> (other minus base) and verdict: improved, regressed or inconclusive."""
    pick = lambda v, m: F.max(F.when(F.col(variant) == v, F.col(m)))
    d = metrics.groupBy(*keys).agg(*[(pick(other, m) - pick(base, m)).alias(f"delta_{m}") for m in names])
    acc, f1, fail = (F.col(f"delta_{m}") for m in ("accuracy", "macro_f1", "parse_failure_rate"))
    return d.withColumn("verdict", F.when((acc > 0) & (f1 > 0) & (fail <= 0), "improved").when((acc < 0) | (f1 < 0) | (fail > 0), "regressed").otherwise("inconclusive"))


def long_metrics(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """A row per metric: keys, metric, value."""
    return df.select(*keys, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names])))


def metric_wins(metrics: DataFrame, task: str, variant: str, metric: str, candidate: str, baselines: list[str]) -> DataFrame:
    """Per baseline: tasks where the candidate's metric is strictly above (wins) and strictly below it (regressions).

    A metric missing on either side is neither.
    """
    wide = metrics.groupBy(task).agg(*[F.max(F.when(F.col(variant) == v, F.col(metric))).alias(f"m{i}") for i, v in enumerate([candidate, *baselines])])
    pairs = F.array(*[F.struct(F.lit(b).alias("baseline"), (F.col("m0") - F.col(f"m{i}")).alias("d")) for i, b in enumerate(baselines, 1)])
    return wide.select(F.inline(pairs)).groupBy("baseline").agg(F.count_if(F.col("d") > 0).alias("wins"), F.count_if(F.col("d") < 0).alias("regressions"))


def metric_differences(long: DataFrame, keys: list[str], variant: str, a: str, b: str) -> DataFrame:
    """keys, metric, value of a and of b, difference (b less a; null if either is missing) from a long metrics table."""
    pick = lambda v: F.max(F.when(F.col(variant) == v, F.col("value")))
    return long.groupBy(*keys, "metric").agg(pick(a).alias("value_a"), pick(b).alias("value_b"), (pick(b) - pick(a)).alias("difference"))


def snapshot(now: DataFrame, baseline: DataFrame, key: str, metrics: list[str], carried: list[str]) -> DataFrame:
    """key, carried columns of ``now``, and per metric its value, its baseline and their difference; null where either is missing."""
    b = baseline.select(F.col(key).alias("__k"), *[F.col(m).alias(f"baseline_{m}") for m in metrics])
    x = now.join(b, F.col(key) == F.col("__k"), "full").withColumn(key, F.coalesce(key, "__k"))
    return x.select(key, *carried, *[c for m in metrics for c in (F.col(m), F.col(f"baseline_{m}"), (F.col(m) - F.col(f"baseline_{m}")).alias(f"delta_{m}"))])
