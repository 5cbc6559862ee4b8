"""Jobs claimed under a lease, as keyed state over a log (idempotent consume, L3).

The log has (job_id, event, attempt, at). One state row per job says which attempt holds the lease and until when, so a job that is
queued again, in whatever batch, is handed over once; an attempt that finishes after its lease has run out
finds another attempt in its place and changes nothing. What a job's rows lead to depends on their times only and not on
how they fall into batches, and state and log advance together with the checkpoint, so a batch that is run again writes the same rows.

Events
- ``queued``: a job without state is claimed; any other is left alone.
- ``renewed``: the lease of the attempt that holds it starts anew.
- ``completed``, ``failed``, ``cancelled``: the job ends. ``attempt`` null means whoever holds it.
A lease that runs out at its last instant or before returns the job to the queue, where it is claimed again at that
instant, at most ``most_attempts`` times; then the job has failed. Timers on the watermark do so for jobs of which
nothing more is heard.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LOG = "job_id string, event string, attempt int, at timestamp"
CLAIMS = "job_id string, attempt int, status string, at timestamp"
STATE = "status string, attempt int, until long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# What ends a job, and the order of events of one instant.
ENDS = ("completed", "failed", "cancelled")
ORDER = ("queued", "renewed", *ENDS)


def _micros(at: dt.datetime) -> int:
    return round(at.timestamp() * 1_000_000)


class Lease:
    """One job: its state as (status, attempt, end of the lease in microseconds), and the rows that events write."""

    def __init__(self, job_id: str, state: tuple | None, lease: int, most_attempts: int):
        self.job_id, self.lease, self.most_attempts = job_id, lease, most_attempts
        self.status, self.attempt, self.until = state or ("unknown", 0, 0)
        self.rows: list[tuple[int, str, int]] = []

    def _write(self, status: str, at: int) -> None:
        self.rows.append((self.attempt, status, at))

    def _claim(self, at: int) -> None:
        self.status, self.attempt, self.until = "claimed", self.attempt + 1, at + self.lease
        self._write("claimed", at)

    def expire(self, now: int) -> None:
        """Leases that have run out by ``now``, one after the other."""
        while self.status == "claimed" and self.until <= now:
            at = self.until
            if self.attempt < self.most_attempts:
                self._write("expired", at)
                self._claim(at)
            else:
                self.status = "failed"
                self._write("failed", at)

    def event(self, name: str, attempt: int | None, at: int) -> None:
        self.expire(at)
        if name == "queued" and self.status == "unknown":
            self._claim(at)
        elif self.status == "claimed" and attempt in (None, self.attempt):
            if name == "renewed":
                self.until = at + self.lease
            elif name in ENDS:
                self.status = name
                self._write(name, at)


class Claims(StatefulProcessor):
    """``Lease`` over stored state; the timer stands at the end of the lease."""

    def __init__(self, lease: dt.timedelta, most_attempts: int):
        self.lease, self.most_attempts = lease // dt.timedelta(microseconds=1), most_attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("lease", STATE)

    def _after(self, key: Any, act) -> Iterator[Row]:
        # Every call to the state is a message to the store, so none is made that changes nothing.
        before = self.state.get()
        job = Lease(key[0], before, self.lease, self.most_attempts)
        act(job)
        timer = -(-job.until // 1000) if job.status == "claimed" else None
        old = -(-before[2] // 1000) if before and before[0] == "claimed" else None
        if old != timer:
            if old is not None:
                self.handle.deleteTimer(old)
            if timer is not None:
                self.handle.registerTimer(timer)
        if job.status != "unknown" and (job.status, job.attempt, job.until) != (before and tuple(before)):
            self.state.update((job.status, job.attempt, job.until))
        for attempt, status, at in job.rows:
            yield Row(job_id=job.job_id, attempt=attempt, status=status, at=dt.datetime.fromtimestamp(at / 1_000_000))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        heard = sorted((_micros(r.at), ORDER.index(r.event), r.event, r.attempt) for r in rows if r.event in ORDER and r.at is not None)

        def act(job: Lease) -> None:
            for at, _, event, attempt in heard:
                job.event(event, attempt, at)

        yield from self._after(key, act)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        # All leases up to the watermark: a timer that is set now for an instant before it would wait for another batch.
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        yield from self._after(key, lambda job: job.expire(now))

    def close(self) -> None:
        pass


def claim_jobs(log: DataFrame, lease: dt.timedelta, most_attempts: int = 3, late: str = "0 seconds") -> DataFrame:
    """job_id, attempt, status, at of a streaming log; rows later than ``late`` are not heard. Needs the RocksDB state store."""
    heard = log.where("job_id IS NOT NULL AND at IS NOT NULL").withWatermark("at", late)
    processor = Claims(lease, most_attempts)
    return heard.groupBy("job_id").transformWithState(statefulProcessor=processor, outputStructType=CLAIMS, outputMode="Append", timeMode="EventTime")


def run_claims(spark: SparkSession, source: str, target: str, checkpoint: str, lease: dt.timedelta, most_attempts: int = 3, late: str = "0 seconds") -> None:
    """Claims of a Parquet log appended to ``target`` until the log is read; called again it goes on from the checkpoint."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        claims = claim_jobs(spark.readStream.schema(LOG).parquet(source), lease, most_attempts, late)
        claims.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def append_log(log: DataFrame, path: str) -> None:
    """Append rows to a log."""
    rows = log.select(F.col("job_id").cast("string").alias("job_id"), "event", F.col("attempt").cast("int").alias("attempt"), F.col("at").cast("timestamp").alias("at"))
    rows.write.mode("append").parquet(path)
