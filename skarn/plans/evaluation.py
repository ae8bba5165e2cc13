"""Metric and run-comparison queries. Runs are predictions of a line item's return flag by rules on other columns, with
missing and unknown predictions; parsed outputs of records serve for structured metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.operators import evaluate as E
from skarn.operators.splitting import hash_order, top_per_group
from skarn.plans.texts import OUTPUTS_SQL, parsed_predictions
from skarn.sources.tables import table as T

FLAGS = {"A": "positive", "R": "negative", "N": "neutral"}
LABELS = ["negative", "neutral", "positive"]


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """variant, dataset, example_id, gold, pred for a base and a tuned rule."""
    i = T(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("f"), F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"), F.min("l_linestatus").alias("dataset"))
    gold = F.create_map(*[F.lit(x) for kv in FLAGS.items() for x in kv])[F.col("f")]
    rule = lambda m: F.when(F.col("p") % m == 0, F.lit(None)).when(F.col("p") % m == 1, "no").when(F.col("p") % m < 4, gold).when(F.col("s") % 3 == 0, "positive").when(F.col("s") % 3 == 1, "negative").otherwise("neutral")
    runs = F.array(*[F.struct(F.lit(v).alias("variant"), rule(m).alias("pred")) for v, m in (("base", 11), ("tuned", 7))])
    return i.select("dataset", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("example_id"), gold.alias("gold"), F.inline(runs))


def confusion_matrix(spark, d):
    return E.confusion(_runs(spark, d), ["dataset", "variant"])


def class_metrics(spark, d):
    x = E.class_metrics(_runs(spark, d), ["dataset", "variant"], LABELS)
    return x.select("dataset", "variant", "label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


def _summary(spark: SparkSession, d: str) -> DataFrame:
    return E.summary_metrics(_runs(spark, d), ["dataset", "variant"], LABELS)


def summary_metrics(spark, d):
    return _summary(spark, d).select("dataset", "variant", "sample_count", "invalid_count", *[F.round(c, 6).alias(c) for c in ("accuracy", "macro_f1", "parse_failure_rate")])


def metrics_long(spark, d):
    x = E.long_metrics(_summary(spark, d), ["dataset", "variant"], ["accuracy", "macro_f1", "parse_failure_rate"])
    return x.select("dataset", "variant", "metric", F.round("value", 6).alias("value"))


def run_verdicts(spark, d):
    x = E.metric_deltas(_summary(spark, d), ["dataset"], "variant", "base", "tuned", ["accuracy", "macro_f1", "parse_failure_rate"])
    return x.select("dataset", *[F.round(c, 6).alias(c) for c in ("delta_accuracy", "delta_macro_f1", "delta_parse_failure_rate")], "verdict")


def metric_wins(spark, d):
    return E.metric_wins(_summary(spark, d), "dataset", "variant", "macro_f1", "tuned", ["base", "absent"])


def metric_differences(spark, d):
    long = E.long_metrics(_summary(spark, d), ["dataset", "variant"], ["accuracy", "macro_f1"])
    x = E.metric_differences(long, ["dataset"], "variant", "base", "tuned")
    return x.select("dataset", "metric", *[F.round(c, 6).alias(c) for c in ("value_a", "value_b", "difference")])


def _compared(spark: SparkSession, d: str) -> DataFrame:
    r = _runs(spark, d)
    return E.compare_runs(r.where("variant = 'base'"), r.where("variant = 'tuned'"), "example_id")


def compare_runs(spark, d):
    return _compared(spark, d).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def shift_counts(spark, d):
    return E.shift_counts(_compared(spark, d))


def regression_buckets(spark, d):
    """The first ten examples of each outcome but the one where both are right, by hash."""
    x = _compared(spark, d).where("outcome <> 'both_right'")
    return top_per_group(x, ["outcome"], [hash_order(F.col("example_id"), seed=1), F.col("example_id")], 10).select("outcome", "rank", "example_id", "gold", "pred_a", "pred_b")


def output_diagnostics(spark, d):
    """Rates and means over outputs: compliance, failures, reasoning, truncation, lengths and time."""
    c = F.col
    flags = {
        "parse_failure_rate": c("pred").isNull(), "format_compliance_rate": c("format_compliant"), "contains_think_rate": c("contains_think"), "malformed_think_tag_rate": c("malformed"), "truncated_output_rate": c("output_truncated"),
        "json_after_reasoning_text_rate": c("json_after_text"), "parseable_after_strip_rate": c("has_answer") & c("pred").isNotNull(),
    }
    y = E.rate_summary(parsed_predictions(spark, d), [], flags, {"mean_output_chars": F.length("raw_output"), "mean_output_tokens": c("generated_tokens"), "mean_latency_seconds": c("latency_seconds")})
    return y.select("sample_count", *[F.round(x, 6).alias(x) for x in y.columns if x != "sample_count"])


def structured_match(spark, d):
    x = parsed_predictions(spark, d)
    y = E.structured_match(x, [], {k: (F.col(f"pred{s}"), F.col(f"gold{s}")) for k, s in (("direction", ""), ("magnitude", "_magnitude"), ("event_type", "_event_type"))})
    return y.select("sample_count", *[F.round(c, 6).alias(c) for c in ("exact_match_rate", "direction_accuracy", "magnitude_accuracy", "event_type_accuracy")])


def metric_snapshot(spark, d):
    """The tuned run's figures per dataset beside a baseline that lacks one dataset and has another; what either lacks is null."""
    x = _summary(spark, d)
    base = x.where("variant = 'base' and dataset <> 'F'").select("dataset", "accuracy").unionByName(spark.createDataFrame([("absent", 0.5)], "dataset string, accuracy double"))
    y = E.snapshot(x.where("variant = 'tuned'"), base, "dataset", ["accuracy"], ["sample_count", "macro_f1"])
    return y.select("dataset", "sample_count", *[F.round(c, 6).alias(c) for c in ("macro_f1", "accuracy", "baseline_accuracy", "delta_accuracy")])


QUERIES = {f.__name__: f for f in (confusion_matrix, class_metrics, summary_metrics, metrics_long, run_verdicts, metric_wins, metric_differences, compare_runs, shift_counts, regression_buckets, output_diagnostics, structured_match, metric_snapshot)}

_RULE = lambda m: f"case when p % {m} = 0 then null when p % {m} = 1 then 'no' when p % {m} < 4 then gold when s % 3 = 0 then 'positive' when s % 3 = 1 then 'negative' else 'neutral' end"
_RUNS = f"""g as (select l_orderkey || '-' || l_linenumber as example_id, min(l_linestatus) as dataset, case min(l_returnflag) when 'A' then 'positive' when 'R' then 'negative' else 'neutral' end as gold, min(l_partkey) as p, min(l_suppkey) as s from lineitem group by l_orderkey, l_linenumber),
runs as (select dataset, example_id, gold, 'base' as variant, {_RULE(11)} as pred from g union all select dataset, example_id, gold, 'tuned', {_RULE(7)} from g),
lbl as (select unnest(['negative', 'neutral', 'positive']) as label),
cell as (select dataset, variant, label, count(*) filter (gold = label and pred = label) as tp, count(*) filter (gold <> label and pred = label) as fp, count(*) filter (gold = label and pred is distinct from label and coalesce(pred, '') <> 'no') as fn,
  count(*) filter (gold = label and coalesce(pred, '') <> 'no') as support from runs, lbl group by all),
pr as (select *, coalesce(tp / nullif(tp + fp, 0), 0.0) as precision, coalesce(tp / nullif(tp + fn, 0), 0.0) as recall from cell),
cm as (select *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) as f1 from pr),
sm as (select r.*, macro_f1 from (select dataset, variant, count(*) as sample_count, count(*) filter (pred is null) as invalid_count, count(*) filter (pred = gold) / count(*) as accuracy, count(*) filter (pred is null) / count(*) as parse_failure_rate from runs group by all) r
  join (select dataset, variant, avg(f1) as macro_f1 from cm group by all) using (dataset, variant)),
dl as (select t.dataset, t.accuracy - b.accuracy as da, t.macro_f1 - b.macro_f1 as df, t.parse_failure_rate - b.parse_failure_rate as dp from sm t join sm b using (dataset) where t.variant = 'tuned' and b.variant = 'base'),
cp as (select a.example_id, a.gold, a.pred as pred_a, b.pred as pred_b, coalesce(a.pred = a.gold, false) as ra, coalesce(b.pred = b.gold, false) as rb from runs a join runs b using (example_id) where a.variant = 'base' and b.variant = 'tuned'),
oc as (select *, case when rb and not ra then 'win' when ra and not rb then 'regression' when ra then 'both_right' else 'both_wrong' end as outcome from cp)"""

SQL = {
    "confusion_matrix": f"with {_RUNS} select dataset, variant, gold, coalesce(pred, '__invalid__') as pred, count(*) as n from runs group by all",
    "class_metrics": f"with {_RUNS} select dataset, variant, label, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, support from cm",
    "summary_metrics": f"with {_RUNS} select dataset, variant, sample_count, invalid_count, round(accuracy, 6) as accuracy, round(macro_f1, 6) as macro_f1, round(parse_failure_rate, 6) as parse_failure_rate from sm",
    "metrics_long": f"with {_RUNS} select dataset, variant, 'accuracy' as metric, round(accuracy, 6) as value from sm union all select dataset, variant, 'macro_f1', round(macro_f1, 6) from sm union all select dataset, variant, 'parse_failure_rate', round(parse_failure_rate, 6) from sm",
    "run_verdicts": f"with {_RUNS} select dataset, round(da, 6) as delta_accuracy, round(df, 6) as delta_macro_f1, round(dp, 6) as delta_parse_failure_rate, case when da > 0 and df > 0 and dp <= 0 then 'improved' when da < 0 or df < 0 or dp > 0 then 'regressed' else 'inconclusive' end as verdict from dl",
    "metric_snapshot": f"""with {_RUNS}, b as (select dataset, accuracy from sm where variant = 'base' and dataset <> 'F' union all select 'absent', 0.5), t as (select * from sm where variant = 'tuned')
select coalesce(t.dataset, b.dataset) as dataset, sample_count, round(macro_f1, 6) as macro_f1, round(t.accuracy, 6) as accuracy, round(b.accuracy, 6) as baseline_accuracy, round(t.accuracy - b.accuracy, 6) as delta_accuracy from t full join b on t.dataset = b.dataset""",
    "metric_wins": f"with {_RUNS} select 'base' as baseline, count(*) filter (df > 0) as wins, count(*) filter (df < 0) as regressions from dl union all select 'absent', 0, 0",
    "metric_differences": f"""with {_RUNS}, l as (select dataset, variant, unnest([{{'m': 'accuracy', 'v': accuracy}}, {{'m': 'macro_f1', 'v': macro_f1}}]) as x from sm)
select dataset, x.m as metric, round(max(x.v) filter (variant = 'base'), 6) as value_a, round(max(x.v) filter (variant = 'tuned'), 6) as value_b, round(max(x.v) filter (variant = 'tuned') - max(x.v) filter (variant = 'base'), 6) as difference from l group by all""",
    "compare_runs": f"with {_RUNS} select outcome, count(*) as n from oc group by outcome",
    "shift_counts": f"with {_RUNS} select coalesce(pred_a, 'None') || '->' || coalesce(pred_b, 'None') as shift, count(*) as n, count(*) filter (gold = 'neutral' and pred_b in ('positive', 'negative')) as neutral_overcalls from oc where outcome = 'regression' group by 1",
    "regression_buckets": f"with {_RUNS}, r as (select *, cast(row_number() over (partition by outcome order by md5(example_id || '#1'), example_id) as integer) as rank from oc where outcome <> 'both_right') select outcome, rank, example_id, gold, pred_a, pred_b from r where rank <= 10",
    "output_diagnostics": f"with {OUTPUTS_SQL} select count(*) as sample_count, "
    + ", ".join(f"round(coalesce(avg(coalesce(({x})::int, 0)), 0), 6) as {n}" for n, x in {
        "parse_failure_rate": "pred is null", "format_compliance_rate": "format_compliant", "contains_think_rate": "contains_think", "malformed_think_tag_rate": "malformed", "truncated_output_rate": "output_truncated",
        "json_after_reasoning_text_rate": "json_after_text", "parseable_after_strip_rate": "has_answer and pred is not null",
    }.items())
    + ", round(avg(length(raw_output)), 6) as mean_output_chars, round(avg(generated_tokens), 6) as mean_output_tokens, round(avg(latency_seconds), 6) as mean_latency_seconds from pred",
    "structured_match": f"""with {OUTPUTS_SQL}, s as (select pred is not distinct from gold as a, pred_magnitude is not distinct from gold_magnitude as b, pred_event_type is not distinct from gold_event_type as c from pred)
select count(*) as sample_count, round(avg((a and b and c)::int), 6) as exact_match_rate, round(avg(a::int), 6) as direction_accuracy, round(avg(b::int), 6) as magnitude_accuracy, round(avg(c::int), 6) as event_type_accuracy from s""",
}
