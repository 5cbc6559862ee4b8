"""Immutable document versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlark.functions.dates import lag_seconds


def build_versions(arrivals: DataFrame) -> DataFrame:
    """Version history of each key from its arrivals.

    arrivals: key, version_id, source_hash, matching_hash, retrieved_at, ingested_at, seq. A content hash seen
    before in the key's history makes no new version, even after others (A, B, A keeps B current). A
    version points to its successor, becomes invisible at the successor's retrieval and reuses the
    first version with its matching hash; only such first versions need parsing.
    """
    first = W.partitionBy("key", "source_hash").orderBy("ingested_at", "seq")
    new = arrivals.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")
    chain = W.partitionBy("key").orderBy("ingested_at", "seq")
    same = W.partitionBy("key", "matching_hash").orderBy("ingested_at", "seq")
    root = F.first("version_id").over(same)
    return (
        new.withColumn("superseded_by", F.lead("version_id").over(chain))
        .withColumn("superseded_at", F.lead("retrieved_at").over(chain))
        .withColumn("reused_from", F.when(root != F.col("version_id"), root))
        .withColumn("requires_reparse", F.col("reused_from").isNull())
    )


def latest(versions: DataFrame) -> DataFrame:
    """The newest version of each key."""
    order = W.partitionBy("key").orderBy(F.desc("ingested_at"), F.desc("seq"))
    return versions.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def unseen(arrivals: DataFrame, known: DataFrame) -> DataFrame:
    """Arrivals whose (key, source_hash) is not in the history yet."""
    return arrivals.join(known.select("key", "source_hash").distinct(), ["key", "source_hash"], "left_anti")


def missing_work(versions: DataFrame, jobs: DataFrame) -> DataFrame:
    """Versions without any job of theirs. A failed job is a job: it is not queued again."""
    return versions.join(jobs.select("version_id").distinct(), "version_id", "left_anti")


def freshness(versions: DataFrame, updated: str = "source_updated_at") -> DataFrame:
    """Counts and bounds of a catalogue."""
    return versions.agg(
        F.count("*").alias("n_versions"),
        F.count(updated).alias("n_dated"),
        (F.count("*") - F.count(updated)).alias("n_undated"),
        F.min(updated).alias("oldest_update"),
        F.max(updated).alias("newest_update"),
        F.max("retrieved_at").alias("last_retrieved"),
    )


def catalogue_state(jobs: DataFrame, has_versions: Column) -> DataFrame:
    """updating while any job is queued or running, else ready or empty."""
    busy = F.coalesce(F.bool_or(F.col("status").isin("queued", "running")), F.lit(False))
    return jobs.agg(F.when(busy, "updating").when(has_versions, "ready").otherwise("empty").alias("state"))


def ingest_metrics(jobs: DataFrame, *keys: str) -> DataFrame:
    """Jobs, failed ones and the longest lag between a source's update and its retrieval, in seconds."""
    lag = lag_seconds(F.col("retrieved_at"), F.col("source_updated_at"))
    return jobs.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "failed").alias("n_failed"), F.max(lag).alias("max_lag"))


def page(rows: DataFrame, key: str, size: int = 25) -> DataFrame:
    """The first ``size`` rows by key (1 to 100) with the number of all rows."""
    if not 1 <= size <= 100:
        raise ValueError("a page has 1 to 100 rows")
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(key).limit(size).join(F.broadcast(total))
