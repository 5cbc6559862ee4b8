"""A version history that takes arrivals in deltas and rewrites only what they touch.

The history is kept in buckets by hash of the key, as what ``build_versions`` makes of all arrivals so far. A delta is joined to the
versions of its own keys; only their chains are closed and linked anew, and only the buckets that hold such
keys are written again, as a new generation. A manifest, written last, says which generation of each bucket is
current: a merge that fails leaves files that nobody reads, and readers see the history before or after a merge.

Of arrivals with the same content only the first of a key is a version, so that the versions so far stand for all arrivals
so far, whatever order deltas come in.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlark.operators.versions import build_versions
from siftlark.sources.shared import stored

BUCKETS = 64
#: What ``build_versions`` adds to an arrival.
LINKS = ("superseded_by", "superseded_at", "reused_from", "requires_reparse")


class VersionHistory:
    """Arrivals have key, version_id, source_hash, matching_hash, retrieved_at, ingested_at, seq and any columns of content."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col("key").cast("string")), F.lit(self.buckets)).cast("int")

    def current(self) -> dict[int, str]:
        """The generation of each bucket that has one; there are as many rows as buckets and merges."""
        try:
            manifest = self.spark.read.parquet(f"{self.path}/manifest")
        except AnalysisException:
            return {}
        last = manifest.groupBy("bucket").agg(F.max("generation").alias("generation"))
        return {r.bucket: r.generation for r in last.collect()}

    def _read(self, generations: dict[int, str]) -> DataFrame:
        """Versions of these buckets; others are not even listed for reading."""
        held = self.spark.read.parquet(f"{self.path}/versions")
        chosen = F.lit(False)
        for generation in sorted(set(generations.values())):
            chosen = chosen | ((F.col("generation") == generation) & F.col("bucket").isin(sorted(b for b, g in generations.items() if g == generation)))
        return held.where(chosen).drop("generation")

    def read(self) -> DataFrame:
        """All versions, linked."""
        return self._read(self.current()).drop("bucket")

    def merge(self, delta: DataFrame) -> set[int]:
        """Take in arrivals; the buckets that were written again. Arrivals whose content the history holds touch nothing."""
        before = self.current()
        arrivals = stored(delta.withColumn("bucket", self._bucket()), "delta")
        met = {r.bucket for r in arrivals.select("bucket").distinct().collect()}
        known = {b: g for b, g in before.items() if b in met}
        if known:
            held = self._read(known)
            same = held.select("bucket", "key", "source_hash", F.col("ingested_at").alias("first_at"), F.col("seq").alias("first_seq"))
            # New content, or an earlier arrival of content that is known.
            earlier = F.struct("ingested_at", "seq") < F.struct(F.col("first_at").alias("ingested_at"), F.col("first_seq").alias("seq"))
            fresh = arrivals.join(same, ["bucket", "key", "source_hash"], "left").where(F.col("first_at").isNull() | earlier).drop("first_at", "first_seq")
            arrivals = stored(fresh, "fresh_arrivals")
            met = {r.bucket for r in arrivals.select("bucket").distinct().collect()}
            known = {b: g for b, g in known.items() if b in met}
        if not met:
            return set()
        if known:
            held = self._read(known)
            keys = arrivals.select("bucket", "key").distinct()
            mine = held.join(keys, ["bucket", "key"], "left_semi").drop(*LINKS)
            others = held.join(keys, ["bucket", "key"], "left_anti")
            linked = build_versions(mine.unionByName(arrivals))
            whole = others.unionByName(linked.select(*others.columns))
        else:
            whole = build_versions(arrivals)
        # Named anew in every attempt, so that files of one that failed are never taken for its successor's.
        generation = f"{int(max(before.values(), default='0').split('-')[0]) + 1:08d}-{uuid.uuid4().hex[:12]}"
        # A bucket with very many versions is as many files as there are tasks for its rows.
        written = stored(whole, "merged_versions")
        dealt = written.withColumn("generation", F.lit(generation)).repartition("bucket", F.pmod(F.xxhash64("key", "version_id"), F.lit(4)))
        dealt.write.mode("append").partitionBy("generation", "bucket").parquet(f"{self.path}/versions")
        self.spark.createDataFrame([(b, generation) for b in sorted(met)], "bucket int, generation string").coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        return met
