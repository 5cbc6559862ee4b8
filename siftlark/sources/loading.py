"""Loads that look at the order of their rows before anything of them is visible.

The order of a DataFrame is that of its partitions and of the rows in each. Rows are written aside with their place first, so that
what was checked is what is loaded. Places of a partition are compared with each other, and the bounds of a partition with those of the
one before; the table of bounds has as many rows as there are partitions. Two loads into one table must not run at the same time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlark.sources.shared import stored

#: ``monotonically_increasing_id`` has the partition above these bits and the row below.
ROW_BITS = 33


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``part`` and ``row_no``, their place in the whole, from 0 without gaps."""
    place = F.monotonically_increasing_id()
    placed = stored(rows.withColumn("place", place), "placed_rows")
    placed = placed.withColumn("part", F.shiftright("place", ROW_BITS))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # over partitions
    offsets = placed.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    row_no = F.col("offset") + F.col("place").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return placed.join(F.broadcast(offsets), "part").withColumn("row_no", row_no).drop("place", "offset")


def order_problems(placed: DataFrame, key: str) -> DataFrame:
    """row_no, key and the one before it of numbered rows that do not follow it strictly, or have none."""
    own = W.partitionBy("part").orderBy("row_no")
    inside = placed.select("part", "row_no", F.col(key).alias("key"), F.lag(key).over(own).alias("before"), F.row_number().over(own).alias("nth"))
    chain = W.orderBy("part")  # over partitions
    bounds = placed.groupBy("part").agg(F.max_by(key, "row_no").alias("last")).select("part", F.lag("last").over(chain).alias("last_before"))
    whole = inside.join(F.broadcast(bounds), "part").withColumn("before", F.when(F.col("nth") == 1, F.col("last_before")).otherwise(F.col("before")))
    return whole.where(F.col("key").isNull() | (F.col("key") <= F.col("before"))).select("row_no", "key", "before")


def load_in_order(rows: DataFrame, path: str, key: str) -> int:
    """Append rows that rise strictly by ``key``, from what the table holds on; a load out of order is refused as a whole. Returns the rows added."""
    spark = rows.sparkSession
    placed = numbered(rows)
    wrong = order_problems(placed, key).orderBy("row_no").first()
    if wrong is not None:
        raise ValueError(f"row {wrong.row_no} with {key} {wrong.key} does not follow {wrong.before}")
    try:
        last = spark.read.parquet(path).agg(F.max(key)).first()[0]
    except AnalysisException:
        last = None
    first = placed.agg(F.min(key)).first()[0]
    if last is not None and first is not None and first <= last:
        raise ValueError(f"rows must follow {last} in {key}")
    n = placed.count()
    placed.drop("part", "row_no").write.mode("append").parquet(path)
    return n


def index_mismatches(rows: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """row_no, found and expected where the order of rows is not that of an index (row_no, id), or one of them is longer."""
    at = numbered(rows).select("row_no", F.col(key).alias("found"))
    both = at.join(index.select("row_no", F.col("id").alias("expected")), "row_no", "full_outer")
    return both.where(~F.col("found").eqNullSafe(F.col("expected")))


def append_returning(rows: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Append rows whose keys the table lacks, and the keys of those that were added."""
    fresh = rows.dropDuplicates(keys)
    try:
        fresh = fresh.join(rows.sparkSession.read.parquet(path).select(*keys), keys, "left_anti")
    except AnalysisException:
        pass
    added = stored(fresh, "added_rows")
    added.write.mode("append").parquet(path)
    return added.select(*keys)
