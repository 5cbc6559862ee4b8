"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by the SHA-256 digest of the normalised text.
A batch is first reduced to one row per digest (partial aggregation on the map side, so a group
of copies that holds a third of all rows costs one row per task), then anti-joined against the
index by sort-merge join; only new digests are appended. The index side of that join is read in
its buckets, without a shuffle.

Defined results
- A null text counts as empty; empty texts are equal to each other.
- Of equal texts in a batch the row with the smallest ``doc_id`` stays, null ids last; among
  repeated rows of that id exactly one stays.
- A text that an earlier batch holds is dropped and keeps the earlier batch's ``keep_id``.
- Running a batch again under the same name gives the same rows: a digest that this batch added
  still counts as its own.
- An empty table gives an empty result. Further columns of the input are ignored, whatever
  their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlark.llm.common import SPACE, join_groups, materialize, quoted, shared_path, text_of

#: At 100 TB take thousands: a bucket should hold about a gigabyte of digests.
BUCKETS = 16


def normalized(column: str = "text") -> Column:
    """The text with every run of ASCII white space replaced by one blank."""
    return F.regexp_replace(text_of(column), SPACE, " ")


class DigestIndex:
    """A growing table (digest, keep_id, batch), bucketed and sorted by digest."""

    def __init__(self, spark: SparkSession, table: str, location: str, buckets: int = BUCKETS):
        self.spark, self.table, self.buckets = spark, table, buckets
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{location}'"
        )

    @classmethod
    def fresh(cls, spark: SparkSession, buckets: int = BUCKETS) -> DigestIndex:
        """A new empty index in the shared folder."""
        path = shared_path(spark, "digest_index")
        return cls(spark, path.rsplit("/", 1)[1].replace("-", "_"), path, buckets)

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, groups: DataFrame) -> None:
        """Add digests that the index lacks: one file per bucket and batch."""
        new = groups.join(self.read().select("digest").hint("merge"), "digest", "left_anti")
        new.select("digest", "keep_id", "batch").repartition(self.buckets, "digest").write.insertInto(self.table)

    def deduplicate(self, docs: DataFrame, batch: str = "batch") -> DataFrame:
        """Append the new texts of ``docs``; one row per document with its group and whether it stays."""
        rows = materialize(
            docs.select(
                F.col("doc_id").cast("long").alias("doc_id"),
                F.unhex(F.sha2(normalized(), 256)).alias("digest"),
                F.monotonically_increasing_id().alias("row_no"),
            ),
            "digests",
        )
        first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_no"))
        groups = materialize(
            rows.groupBy("digest")
            .agg(first.alias("first"), F.count("*").alias("group_size"))
            .select("digest", F.col("first.doc_id").alias("keep_id"), F.col("first.row_no").alias("keep_row"), "group_size", F.lit(batch).alias("batch")),
            "digest_groups",
        )
        self.append(groups)
        known = self.read().select("digest", F.col("keep_id").alias("known_id"), F.col("batch").alias("known_batch"))
        decided = materialize(
            groups.join(known.hint("merge"), "digest").select(
                "digest",
                F.col("known_id").alias("keep_id"),
                F.when(F.col("known_batch") == batch, F.col("keep_row")).alias("keep_row"),
                "group_size",
            ),
            "digest_decisions",
        )
        return join_groups(rows, decided, "digest", "group_size").select(
            "doc_id",
            "keep_id",
            "group_size",
            F.coalesce(F.col("row_no") == F.col("keep_row"), F.lit(False)).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )


def exact_dedup(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Deduplicate ``docs`` against a fresh index."""
    return DigestIndex.fresh(docs.sparkSession, buckets).deduplicate(docs)


def drop_exact_copies(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Of rows with the same id and equal texts the one whose raw text has the smallest hash stays. Columns may
    have any names; those of ``docs`` travel in one struct.
    """
    key = lambda i, sha: F.concat_ws(":", F.coalesce(i.cast("string"), F.lit("null")), sha)
    stay = exact_dedup(docs, buckets).where("kept").select(key(F.col("doc_id"), F.col("text_sha256")).alias("row_key")).distinct()
    keyed = docs.select(key(F.col("doc_id").cast("long"), F.sha2(normalized(), 256)).alias("row_key"), F.struct(*quoted(docs)).alias("row"))
    return keyed.join(stay, "row_key", "left_semi").groupBy("row_key").agg(F.min_by("row", F.xxhash64("row.text")).alias("row")).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY sha) AS keep_id,
       count(*) OVER (PARTITION BY sha) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY sha) AS kept,
       sha AS text_sha256
FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS sha FROM documents)
"""
