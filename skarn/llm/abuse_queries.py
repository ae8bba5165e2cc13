"""Queries p9 over the document corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.functions.keys import folded
from skarn.llm.abuse import fit, score_texts, verdict_sample
from skarn.sources.tables import table

#: Of so many verdicts one is held out by p9_heldout.
HELD_OUT_OF = 5


def _labels(spark: SparkSession, d: str, where: Column | None = None) -> DataFrame:
    labels = table(spark, d, "review_labels")
    return labels if where is None else labels.where(where)


def _scored(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    model = fit(verdict_sample(docs, "doc_id", "text", _labels(spark, d), "abusive"))
    return score_texts(docs, "doc_id", "text", model, [F.coalesce(folded(F.col("source")), F.lit("unknown")).alias("source")])


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).where("abusive").select("doc_id")


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d)


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    """Rates per source."""
    return _scored(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if("abusive").alias("abusive"), F.avg(F.col("abusive").cast("double")).alias("rate"), F.avg("severity").alias("mean_severity"))


def p9_heldout(spark: SparkSession, d: str) -> DataFrame:
    """How a model fitted on four fifths of the verdicts agrees with the rest: verdicts, yes, flagged, both, recall, precision.

    Copies of a text are on one side. Reviewers err in a few verdicts, so neither figure can reach 1.
    """
    docs = table(spark, d, "documents")
    judged = verdict_sample(docs, "doc_id", "text", _labels(spark, d), "abusive")
    held = F.pmod(F.xxhash64("text"), F.lit(HELD_OUT_OF)) == 0
    scored = score_texts(judged.where(held), "id", "text", fit(judged.where(~held)), [F.col("y")])
    yes = F.col("y") == 1
    x = scored.agg(F.count(F.lit(1)).alias("verdicts"), F.count_if(yes).alias("yes"), F.count_if("abusive").alias("flagged"), F.count_if(yes & F.col("abusive")).alias("both"))
    return x.withColumns({"recall": F.try_divide("both", "yes"), "precision": F.try_divide("both", "flagged")})


QUERIES = {"p9_found": p9_found, "p9_scores": p9_scores, "p9_report": p9_report, "p9_heldout": p9_heldout}
SQL: dict[str, str] = {}
