"""Queries of streams over the driver's tables, and the same rows in DuckDB SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlark.plans import adapters as A
from siftlark.plans.registry import query
from siftlark.sources import cursor
from siftlark.sources.shared import shared_path, stored
from siftlark.streaming import claims

#: Orders of a page, by key.
PAGE_KEYS = 1000


@query(f"""WITH placed AS (SELECT o_orderkey, o_custkey, o_orderkey // {PAGE_KEYS} AS p FROM orders),
numbered AS (SELECT *, dense_rank() OVER (ORDER BY p) AS page_no, row_number() OVER (PARTITION BY p ORDER BY o_orderkey) AS place FROM placed)
SELECT page_no, place, o_orderkey AS order_key, o_custkey AS customer_key, NULL AS problem FROM numbered WHERE page_no % 7 <> 3
UNION ALL SELECT DISTINCT page_no, 0, NULL, NULL, 'invalid_page' FROM numbered WHERE page_no % 7 = 3
UNION ALL SELECT max(page_no), 0, NULL, NULL, 'repeated_cursor' FROM numbered""")
def s3_cursor_pages(spark, sf_dir):
    """Orders as saved pages, half of them there when the stream first runs and all when it goes on; every seventh page is broken and the last one names an old cursor."""
    orders = A.table(spark, sf_dir, "orders").withColumn("p", F.floor(F.col("o_orderkey") / PAGE_KEYS).cast("long"))
    study = F.to_json(F.struct("o_orderkey", "o_custkey"))
    bodies = stored(orders.groupBy("p").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", study.alias("s")))), lambda x: x["s"]).alias("studies")), "page_bodies")
    chain = W.orderBy("p")  # over pages, of which there are few
    token = lambda c: F.when(c.isNotNull(), F.md5(c.cast("string")))
    numbers = bodies.select("p").select("p", F.row_number().over(chain).alias("page_no"), F.lead("p").over(chain).alias("after"))
    named = numbers.withColumn("cursor", F.when(F.col("page_no") == 1, F.lit(cursor.START)).otherwise(token(F.col("p"))))
    n = numbers.count()
    second = named.where("page_no = 2").first()
    end = F.lit(second["cursor"] if second else " ")
    pages = stored(
        bodies.join(named, "p").select(
            "page_no", "cursor", F.coalesce(token(F.col("after")), end).alias("next_cursor"), F.when(F.col("page_no") % 7 != 3, F.col("studies")).alias("studies")
        ),
        "pages",
    )
    path, target, checkpoint = (shared_path(spark, x) for x in ("saved_pages", "page_rows", "page_checkpoint"))
    # The selection has one page more than there are, so that it is the cursor that ends it.
    options = {"path": path, "last_page": str(n + 1)}
    for part in (F.col("page_no") <= n // 2, F.col("page_no") > n // 2):
        cursor.save_pages(pages.where(part), path)
        cursor.append_pages(spark, options, target, checkpoint)
    key = lambda name: F.get_json_object("study", f"$.{name}").cast("long")
    return spark.read.schema(cursor.SCHEMA).parquet(target).select("page_no", "place", key("o_orderkey").alias("order_key"), key("o_custkey").alias("customer_key"), "problem")


LEASE_DAYS, MOST_ATTEMPTS, SLICES = 200, 3, 3


@query(f"""WITH log AS (SELECT o_custkey::VARCHAR AS job_id, CASE WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'queued' END AS event, o_orderdate::TIMESTAMP AS t FROM orders),
heard AS (SELECT max(t) AS w FROM log),
first AS (SELECT job_id, min(t) AS q FROM log WHERE event = 'queued' GROUP BY job_id),
jobs AS (SELECT f.job_id, q, min(l.t) AS c FROM first f LEFT JOIN log l ON l.job_id = f.job_id AND l.event = 'completed' AND l.t >= q GROUP BY ALL),
steps AS (SELECT *, q + to_days(({LEASE_DAYS} * k)::INTEGER) AS e FROM jobs, range({MOST_ATTEMPTS + 1}) r(k), heard)
SELECT job_id, (k + 1)::INTEGER AS attempt, 'claimed' AS status, e AS at FROM steps WHERE k < {MOST_ATTEMPTS} AND (k = 0 OR (c IS NULL OR c >= e) AND e <= w)
UNION ALL SELECT job_id, k, CASE WHEN k < {MOST_ATTEMPTS} THEN 'expired' ELSE 'failed' END, e FROM steps WHERE k > 0 AND (c IS NULL OR c >= e) AND e <= w
UNION ALL SELECT job_id, date_diff('day', q, c) // {LEASE_DAYS} + 1, 'completed', c FROM jobs WHERE c < q + to_days({LEASE_DAYS * MOST_ATTEMPTS})""")
def l3_leased_claims(spark, sf_dir):
    """Customers as jobs: an open order queues them, a filled one completes them; the log comes in slices of time and the query is started anew for each."""
    event = F.when(F.col("o_orderstatus") == "F", "completed").otherwise("queued")
    orders = A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job_id"), event.alias("event"), F.lit(None).alias("attempt"), F.col("o_orderdate").cast("timestamp").alias("at"))
    log = stored(orders, "job_log")
    bounds = log.select(F.unix_micros(F.min("at")).alias("a"), F.unix_micros(F.max("at")).alias("b")).first()
    path, target, checkpoint = (shared_path(spark, x) for x in ("claim_log", "claims", "claim_checkpoint"))
    if bounds.a is None:
        return spark.createDataFrame([], claims.CLAIMS)
    width = (bounds.b - bounds.a) // SLICES + 1
    for k in range(SLICES):
        within = F.floor((F.unix_micros("at") - bounds.a) / width) == k
        claims.append_log(log.where(within), path)
        claims.run_claims(spark, path, target, checkpoint, dt.timedelta(days=LEASE_DAYS), MOST_ATTEMPTS)
    return spark.read.schema(claims.CLAIMS).parquet(target)
