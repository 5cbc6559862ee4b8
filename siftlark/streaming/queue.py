"""Durable queues as Structured Streaming over an append-only event log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Which kind of work is claimed first, and the states in their order.
PRIORITY = ("sync", "match", "embedding", "backfill")
STATES = ("queued", "running", "completed", "failed", "cancelled")


def job_states(events: DataFrame) -> DataFrame:
    """The latest state of each job of a log (job_id, kind, status, at)."""
    order = F.array_position(F.array(*[F.lit(s) for s in STATES]), F.col("status"))
    return events.groupBy("job_id", "kind").agg(F.max_by("status", F.struct("at", order)).alias("status"), F.min("at").alias("created_at"))


def next_jobs(events: DataFrame, cancelled: DataFrame, limit: int = 1) -> DataFrame:
    """The oldest queued jobs, by kind first; cancelled ones are passed over."""
    rank = F.array_position(F.array(*[F.lit(k) for k in PRIORITY]), F.col("kind"))
    waiting = job_states(events).where("status = 'queued'").join(cancelled.select("job_id"), "job_id", "left_anti")
    return waiting.withColumn("priority", rank).where("priority > 0").orderBy("priority", "created_at", "job_id").limit(limit)


def drain(spark: SparkSession, source: str, schema: StructType, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> None:
    """Hand the new jobs of a Parquet log to ``handle`` in micro-batches, each once in its batch, then stop.

    The checkpoint remembers what was consumed; a batch that fails is handed over again under the
    same number, and a job that comes twice in different batches is handed over in both, so handlers append by key. For
    one hand-over whatever the batches, and for leases, see ``claims``.
    """

    def one_batch(batch: DataFrame, number: int) -> None:
        handle(batch.dropDuplicates(["job_id"]), number)

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Event counts by type in tumbling windows with a bound on lateness, for the live view of a queue."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"))
