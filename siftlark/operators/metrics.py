"""Ranking and classification metrics (A16-A25, A30, J10, W8). Every rate with an empty denominator is 0 unless stated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def safe_ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.when(b != 0, b), F.lit(0.0))


def gain(grade: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1.0)


def ranking_metrics(rankings: DataFrame, judgments: DataFrame, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Per query: nDCG@5/10, P@5/10, R@50, MRR and grade-1 rate@10. Unjudged documents have grade 0.

    rankings: keys, doc_id, rank; judgments: query_id, doc_id, grade (0, 1, 2). Ideal rankings use all
    judgments of a query. Every judged query gets a row, also without results.
    """
    ideal_order = W.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id")
    ideal = judgments.withColumn("ideal_rank", F.row_number().over(ideal_order)).groupBy("query_id").agg(
        *[F.sum(F.when(F.col("ideal_rank") <= k, gain(F.col("grade"), F.col("ideal_rank")))).alias(f"ideal_{k}") for k in (5, 10)],
        F.count_if(F.col("grade") == 2).alias("total"),
    )
    judged = rankings.join(judgments.select("query_id", "doc_id", "grade"), ["query_id", "doc_id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    two, rank = F.col("grade") == 2, F.col("rank")
    within = lambda k: F.when(rank <= k, gain(F.col("grade"), rank))
    found = judged.groupBy(*keys).agg(
        *[F.sum(within(k)).alias(f"dcg_{k}") for k in (5, 10)],
        *[F.count_if(two & (rank <= k)).alias(f"hits_{k}") for k in (5, 10, 50)],
        F.min(F.when(two, rank)).alias("first"),
        F.count_if((F.col("grade") == 1) & (rank <= 10)).alias("ones"),
        F.count_if(rank <= 10).alias("shown"),
    )
    whole = ideal if keys == ("query_id",) else ideal.crossJoin(rankings.select(*[k for k in keys if k != "query_id"]).distinct())
    merged = whole.join(found, list(keys), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return merged.select(
        *keys,
        *[safe_ratio(F.coalesce(f"dcg_{k}", F.lit(0.0)), F.col(f"ideal_{k}")).alias(f"ndcg_{k}") for k in (5, 10)],
        *[(zero(f"hits_{k}") / F.lit(float(k))).alias(f"precision_{k}") for k in (5, 10)],
        safe_ratio(zero("hits_50").cast("double"), F.col("total")).alias("recall_50"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"),
        safe_ratio(zero("ones").cast("double"), zero("shown")).alias("grade_1_rate_10"),
    )


METRICS = ("ndcg_5", "ndcg_10", "precision_5", "precision_10", "recall_50", "mrr", "grade_1_rate_10")


def mean_metrics(per_query: DataFrame, *by: str) -> DataFrame:
    return per_query.groupBy(*by).agg(*[F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in METRICS])


def macro_f1(pairs: DataFrame) -> DataFrame:
    """Mean F1 over the labels that are expected somewhere. pairs: expected, predicted."""
    counted = pairs.groupBy("expected", "predicted").agg(F.count("*").alias("n"))
    label = lambda side, name: counted.groupBy(F.col(side).alias("label")).agg(F.sum("n").alias(name))
    right = counted.where(F.col("expected") == F.col("predicted")).select(F.col("expected").alias("label"), F.col("n").alias("tp"))
    both = label("expected", "n_expected").join(label("predicted", "n_predicted"), "label", "left").join(right, "label", "left")
    tp = F.coalesce("tp", F.lit(0))
    f1 = 2.0 * tp / (F.col("n_expected") + F.coalesce("n_predicted", F.lit(0)))
    return both.agg(F.coalesce(F.avg(f1), F.lit(0.0)).alias("macro_f1"))


def label_recall(pairs: DataFrame, label: str) -> DataFrame:
    hit = (F.col("expected") == label) & (F.col("predicted") == label)
    return pairs.agg(safe_ratio(F.count_if(hit).cast("double"), F.count_if(F.col("expected") == label)).alias("recall"))


def set_prf(expected: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """Precision, recall and F1 of distinct keys; an empty side is right only beside an empty other side."""
    e = expected.select(key).distinct().withColumn("e", F.lit(1))
    p = predicted.select(key).distinct().withColumn("p", F.lit(1))
    counts = e.join(p, key, "full_outer").agg(
        F.count_if(F.col("e").isNotNull() & F.col("p").isNotNull()).alias("tp"), F.count("e").alias("n_expected"), F.count("p").alias("n_predicted")
    )
    one_or_zero = lambda c: F.when(c, 1.0).otherwise(0.0)
    precision = F.when(F.col("n_predicted") > 0, F.col("tp") / F.when(F.col("n_predicted") > 0, F.col("n_predicted"))).otherwise(one_or_zero(F.col("n_expected") == 0))
    recall = F.when(F.col("n_expected") > 0, F.col("tp") / F.when(F.col("n_expected") > 0, F.col("n_expected"))).otherwise(one_or_zero(F.col("n_predicted") == 0))
    rates = counts.select("tp", "n_expected", "n_predicted", precision.alias("precision"), recall.alias("recall"))
    return rates.withColumn("f1", safe_ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
