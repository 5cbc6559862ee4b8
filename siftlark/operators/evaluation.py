"""Evaluation of retrieval and criteria."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlark.operators import metrics


def histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def criteria_quality(cases: DataFrame) -> DataFrame:
    """One row: macro-F1, exclusion recall, false-clearance rate, evidence precision, abstention rate.

    cases: category, expected, predicted, requires_review, expected_ids[], predicted_ids[]. A case that
    should have stayed open (unknown or conflicting) is falsely cleared if it got a decided outcome and
    no review. Rates of nothing are 0.
    """
    undecided = lambda c: F.col(c).isin("unknown", "conflicting")
    open_case = undecided("expected")
    cleared = open_case & ~undecided("predicted") & ~F.col("requires_review")
    hits = F.size(F.filter("predicted_ids", lambda x: F.array_contains("expected_ids", x)))
    exclusion = F.col("category") == "exclusion"
    due = exclusion & (F.col("expected") == "not_met")
    share = lambda a, b: metrics.safe_ratio(F.coalesce(a, F.lit(0)).cast("double"), b)
    rates = cases.agg(
        share(F.count_if(due & (F.col("predicted") == "not_met")), F.count_if(due)).alias("exclusion_recall"),
        share(F.count_if(cleared), F.count_if(open_case)).alias("false_clearance_rate"),
        share(F.sum(hits), F.sum(F.size("predicted_ids"))).alias("evidence_precision"),
        share(F.count_if("requires_review"), F.count("*")).alias("abstention_rate"),
    )
    return metrics.macro_f1(cases.select("expected", "predicted")).withColumnRenamed("macro_f1", "criterion_macro_f1").join(rates)


def outcome_quality(outcomes: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row of a patient benchmark: macro-F1, exclusion recall, false clearance, evidence presence, share that needs review.

    outcomes: expected, predicted of matches; evidence: n_cited of criterion results.
    """
    review = F.col("expected") == "needs_review"
    excluded = F.col("expected") == "likely_excluded"
    share = lambda a, b: metrics.safe_ratio(a.cast("double"), b)
    rates = outcomes.agg(
        share(F.count_if(excluded & (F.col("predicted") == "likely_excluded")), F.count_if(excluded)).alias("exclusion_recall"),
        share(F.count_if(review & (F.col("predicted") == "potential_match")), F.count_if(review)).alias("false_clearance_rate"),
        share(F.count_if(F.col("predicted") == "needs_review"), F.count("*")).alias("needs_review_rate"),
    )
    cited = evidence.agg(share(F.count_if(F.col("n_cited") > 0), F.count("*")).alias("evidence_presence_rate"))
    return metrics.macro_f1(outcomes).withColumnRenamed("macro_f1", "outcome_macro_f1").join(rates).join(cited)


def candidate_recall(expected: DataFrame, ranked: DataFrame, limit: int) -> DataFrame:
    """Per case (case_id, doc_id or null) the share of expected documents within the limit; a case that expects none has 1."""
    shown = ranked.where(F.col("rank") <= limit).select("case_id", "doc_id", F.lit(1).alias("shown"))
    both = expected.select("case_id", "doc_id").distinct().join(shown, ["case_id", "doc_id"], "left")
    return both.groupBy("case_id").agg(F.when(F.count("doc_id") == 0, 1.0).otherwise(F.count("shown") / F.count("doc_id")).alias("recall"))


def abstention_accuracy(cases: DataFrame) -> DataFrame:
    """Share of cases (n_predicted, abstains) in which the parser found nothing exactly when it should."""
    right = (F.col("n_predicted") == 0) == F.col("abstains")
    return cases.agg(F.coalesce(F.avg(right.cast("double")), F.lit(0.0)).alias("abstention_accuracy"))


def metric_deltas(base: DataFrame, other: DataFrame) -> DataFrame:
    """One row per metric of two one-row reports: both values, the difference, and ``passed``, which is never given by this comparison alone."""
    long = lambda d, name: d.select(F.stack(F.lit(len(metrics.METRICS)), *[x for m in metrics.METRICS for x in (F.lit(m), F.col(m))]).alias("metric", name))
    return long(base, "base").join(long(other, "other"), "metric").select("metric", "base", "other", (F.col("other") - F.col("base")).alias("delta"), F.lit(False).alias("passed"))


def split_of(topic: Column) -> Column:
    """Odd topics tune, even ones are held out."""
    return F.when(topic % 2 == 1, "tuning").otherwise("held_out")


def split_problems(topics: DataFrame, *ranked: DataFrame, first: int = 1, last: int = 50) -> DataFrame:
    """topic and problem: topics beside the fixed protocol, ones of it that are missing, or that a ranking lacks; none, if weights may be tuned.

    The protocol is topics ``first`` to ``last``; with ``split_of`` its two halves cover all of them and share none.
    """
    spark = topics.sparkSession
    own = topics.select(F.col("topic").cast("long").alias("topic")).distinct()
    fixed = spark.range(first, last + 1).select(F.col("id").alias("topic"))
    found = own.join(fixed, "topic", "left_anti").withColumn("problem", F.lit("beside_protocol"))
    found = found.unionByName(fixed.join(own, "topic", "left_anti").withColumn("problem", F.lit("missing")))
    for number, ranks in enumerate(ranked, 1):
        held = ranks.select(F.col("topic").cast("long").alias("topic")).distinct()
        found = found.unionByName(own.join(held, "topic", "left_anti").withColumn("problem", F.lit(f"not_in_ranking_{number}")))
    return found


def best_configuration(swept: DataFrame) -> DataFrame:
    """The configuration with the best tuning nDCG@10, then P@10; of equals the first. swept: ordinal, config, ndcg_10, precision_10."""
    return swept.agg(F.max_by("config", F.struct("ndcg_10", "precision_10", -F.col("ordinal"))).alias("config"))


def topics_that_differ(a: DataFrame, b: DataFrame, key: str = "query_id") -> DataFrame:
    """Topics that only one of two reports covers; none, if they can be compared."""
    one = lambda x, y, name: x.select(key).distinct().join(y.select(key), key, "left_anti").withColumn("only_in", F.lit(name))
    return one(a, b, "first").unionByName(one(b, a, "second"))


def diagnosis(lexical: DataFrame, semantic: DataFrame, worst: int = 10) -> DataFrame:
    """Per topic both nDCG@10 and grade-1 rates, whether the semantic branch is worse, and its place among the ``worst`` rates."""
    from pyspark.sql import Window as W

    side = lambda d, name: d.select("query_id", F.col("ndcg_10").alias(f"{name}_ndcg_10"), F.col("grade_1_rate_10").alias(f"{name}_grade_1_rate"))
    both = side(lexical, "lexical").join(side(semantic, "semantic"), "query_id")
    # Only topics that can be among the worst are put in order in one place.
    top = both.orderBy(F.desc("semantic_grade_1_rate"), "query_id").limit(worst)
    placed = top.select("query_id", F.row_number().over(W.orderBy(F.desc("semantic_grade_1_rate"), "query_id")).alias("place"))
    return both.join(F.broadcast(placed), "query_id", "left").withColumn("semantic_worse", F.round("semantic_ndcg_10", 12) < F.round("lexical_ndcg_10", 12))


def signature(*columns: Column) -> Column:
    """Colon-joined key of a case, for comparing sets of expected and found ones."""
    return F.concat_ws(":", *[c.cast("string") for c in columns])


def pin_problems(found: DataFrame, pinned: dict[str, str]) -> DataFrame:
    """Settings of reports (report_id, settings map) that are missing or differ from the pinned values."""
    checks = [F.when(F.coalesce(F.col("settings")[k] != v, F.lit(True)), F.struct(F.lit(k).alias("setting"), F.col("settings")[k].alias("found"), F.lit(v).alias("pinned"))) for k, v in pinned.items()]
    return found.select("report_id", F.explode(F.filter(F.array(*checks), lambda x: x.isNotNull())).alias("p")).select("report_id", "p.*")



def union_of(*pools: DataFrame) -> DataFrame:
    """The pairs of several pools once, for re-reading their structured fields."""
    return reduce(lambda x, y: x.unionByName(y), [p.select("query_id", "doc_id") for p in pools]).distinct()
