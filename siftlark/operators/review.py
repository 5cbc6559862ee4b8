"""Corrections and displayed outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlark.operators.rules import outcome_of

# Reasons a correction may give.
REASONS = ("evidence_missing", "evidence_conflicting", "evidence_stale", "source_span_issue", "source_data_issue", "other_nonclinical_review_issue")


def current_outcomes(results: DataFrame, corrections: DataFrame) -> DataFrame:
    """Each result with its latest correction by (created_at, id), else its own outcome."""
    last = corrections.groupBy("result_id").agg(F.max_by("corrected", F.struct("created_at", "correction_id")).alias("corrected"), F.count("*").alias("n_corrections"))
    return results.join(last, "result_id", "left").withColumn("current_outcome", F.coalesce("corrected", "outcome")).withColumn("n_corrections", F.coalesce("n_corrections", F.lit(0)))


def displayed_outcomes(current: DataFrame) -> DataFrame:
    """The outcome of each match over current outcomes, without a completeness check."""
    doubtful = F.bool_or(F.col("current_outcome").isin("unknown", "conflicting"))
    return current.groupBy("match_id").agg(outcome_of("category", "current_outcome", doubtful).alias("displayed_outcome"))


def correction_history(results: DataFrame, corrections: DataFrame) -> DataFrame:
    """Every correction with the outcome it replaced, and whether it is admissible (it changes something)."""
    order = W.partitionBy("result_id").orderBy("created_at", "correction_id")
    joined = corrections.join(results.select("result_id", "outcome"), "result_id")
    before = F.coalesce(F.lag("corrected").over(order), F.col("outcome"))
    return joined.withColumn("previous", before).withColumn("position", F.row_number().over(order)).withColumn("changes", F.col("previous") != F.col("corrected"))


def audit_history(results: DataFrame, corrections: DataFrame) -> DataFrame:
    """Evaluation and corrections of each result in order."""
    made = results.select("result_id", F.lit("evaluated").alias("event"), F.col("outcome"), F.col("evaluated_at").alias("at"), F.lit(0).alias("position"))
    fixed = correction_history(results, corrections).select("result_id", F.lit("corrected").alias("event"), F.col("corrected").alias("outcome"), F.col("created_at").alias("at"), "position")
    return made.unionByName(fixed).orderBy("result_id", "position")


def redacted_reason(reason: str) -> Column:
    return F.when(F.col(reason).isin(*REASONS), F.col(reason)).otherwise("legacy_reason_redacted")


def timeline(facts: DataFrame) -> DataFrame:
    """Facts with their place in the patient's timeline: newest first, undated ones last, then the newest entry, then the id."""
    order = W.partitionBy("patient_id").orderBy(F.desc_nulls_last("effective_at"), F.desc("created_at"), "fact_id")
    return facts.withColumn("place", F.row_number().over(order))
