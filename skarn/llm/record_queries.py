"""Queries p4 over rendered training records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.functions.keys import folded
from skarn.llm.json_overlap import near_same_records
from skarn.sources.tables import table

RECORDS = "ibes_pipeline"


def _overlaps(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    df = table(spark, d, RECORDS)
    split = folded(F.col("split"))
    return near_same_records(df, "record_id", F.col("structured_input"), F.when(split == "train", True).when(split.isin("eval", "holdout"), False))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of records is asked for, so classes of copies are written out; p4_links gives the same by record."""
    pairs, members, _ = _overlaps(spark, d)
    a = members.where("train").select(F.col("class").alias("train_class"), F.col("record_id").alias("x"))
    b = members.where("not train").select(F.col("class").alias("eval_class"), F.col("record_id").alias("y"))
    both = pairs.select("train_class", "eval_class").join(a, "train_class").join(b, "eval_class")
    return both.select(F.least("x", "y").alias("record_id_a"), F.greatest("x", "y").alias("record_id_b"))


def p4_links(spark: SparkSession, d: str) -> DataFrame:
    """Per record with any: the number of its near-same records on the other side; copies are counted, not written out."""
    pairs, members, _ = _overlaps(spark, d)
    size = members.groupBy("class", "train").agg(F.count(F.lit(1)).alias("n"))
    side = lambda c, t: size.where(F.col("train") == t).select(F.col("class").alias(c), F.col("n"))
    of_train = pairs.join(side("eval_class", False), "eval_class").groupBy(F.col("train_class").alias("class")).agg(F.sum("n").alias("links")).withColumn("train", F.lit(True))
    of_eval = pairs.join(side("train_class", True), "train_class").groupBy(F.col("eval_class").alias("class")).agg(F.sum("n").alias("links")).withColumn("train", F.lit(False))
    return members.join(of_train.unionByName(of_eval), ["class", "train"]).select("record_id", "links")


def p4_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per evaluation record: the share of its leaves in passages that some training text holds (0 if none)."""
    _, members, coverage = _overlaps(spark, d)
    return members.where("not train").join(coverage, "class", "left").select("record_id", F.coalesce("covered", F.lit(0.0)).alias("covered"))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Per split and source of evaluation records: how many overlap with training, exactly or almost."""
    pairs, members, _ = _overlaps(spark, d)
    best = pairs.groupBy(F.col("eval_class").alias("class")).agg(F.min("differing").alias("differing"))
    rows = members.where("not train").join(best, "class").select("record_id", "differing")
    df = table(spark, d, RECORDS).select("record_id", folded(F.col("split")).alias("split"), F.coalesce(folded(F.col("source")), F.lit("unknown")).alias("source"))
    return (
        df.where("split in ('eval', 'holdout')").join(rows, "record_id", "left").groupBy("split", "source")
        .agg(F.count(F.lit(1)).alias("records"), F.count("differing").alias("overlapping"), F.count_if(F.col("differing") == 0).alias("exact"))
    )


QUERIES = {"p4_found": p4_found, "p4_links": p4_links, "p4_coverage": p4_coverage, "p4_report": p4_report}
#: The leaves the records of this table have.
_LEAVES = [
    "company.company_key", "company.company_name", "company.cusip8", "company.oftic", "company.ticker", "event.currency", "event.event_date", "event.event_id", "event.event_time", "event.event_type",
    "event.fiscal_period_end_date", "event.fpi", "task", *(f"features.{f}" for f in (
        "analyst_count", "consensus_delta", "consensus_max", "consensus_mean", "consensus_median", "consensus_min", "consensus_pct_change", "consensus_std", "estimate_count", "estimator_count", "prior_consensus_mean", "prior_consensus_median")),
]
_VALUES = ", ".join(f"lower(trim(json_extract_string(structured_input, '$.{p}'))) as t{i}" for i, p in enumerate(_LEAVES))
_NUMBERS = ", ".join(f"try_cast(t{i} as double) as n{i}" for i in range(len(_LEAVES)))
_DIFFER = " + ".join(f"(a.t{i} is distinct from b.t{i} and not coalesce(abs(a.n{i} - b.n{i}) <= 0.001 * (1 + 1e-6), false))::int" for i in range(len(_LEAVES)))

_PAIRS = f"""v as (select record_id, lower(trim(split)) as split, {_VALUES} from ibes_pipeline where trim(structured_input) <> ''), x as (select *, {_NUMBERS} from v),
p as (select a.record_id as t, b.record_id as e, {_DIFFER} as d from x a join x b on a.split = 'train' and b.split in ('eval', 'holdout') and {_DIFFER} <= 3)"""

SQL = {
    "p4_found": f"with {_PAIRS} select least(t, e) as record_id_a, greatest(t, e) as record_id_b from p",
    "p4_links": f"with {_PAIRS} select record_id, count(*) as links from (select t as record_id from p union all select e from p) group by record_id",
    "p4_report": f"""with {_PAIRS}, m as (select e, min(d) as d from p group by e)
select lower(trim(split)) as split, coalesce(nullif(lower(trim(source)), ''), 'unknown') as source, count(*) as records, count(d) as overlapping, count(*) filter (d = 0) as exact
from ibes_pipeline left join m on e = record_id where lower(trim(split)) in ('eval', 'holdout') group by 1, 2""",
}
