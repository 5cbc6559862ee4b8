"""URL filters: a temporal join of captures with dated list entries.

A list is a log of events (entry, action, dated). Each event holds until the entry's next event, which
gives validity intervals [since, until); ``clear`` ends an entry. A capture looks up every host suffix
of its URL (``domain:``), its host (``host:``) and every path prefix (``path:``), and the entries valid at
its fetch time decide: the most specific one wins (longer path, then host, then longer domain).

Nothing gathers by entry alone. Events of an entry are put in order inside one day; days are linked by
a window over an entry's days, of which a calendar has few. The as-of join is an equi-join on
(lookup key, month): an interval is listed in every month that it touches up to the last fetch. A list that is
counted to have at most ``LISTED`` such rows goes to every task, and captures are not moved at all. With a longer one,
keys are counted first; those that hold over a thousandth of all lookups, a thousand of them at most, are
dealt over ``SALTS`` parts by capture, and their intervals to each part.

Defined results
- A null or unreadable url has no keys: nothing matches and it is kept. Hosts compare in lower case.
- A null fetch time matches nothing. An event at the very fetch time is already in force.
- Events of one entry at one instant: ``block`` over ``allow`` over ``clear``. Repeated events count once.
  Events with a null entry, action or time are ignored.
- Repeated captures are each evaluated. Empty captures give an empty result; an empty list keeps all.
- Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlark.llm.common import HEAVY_GROUPS, materialize
from siftlark.llm.site_style import host_of


#: Rows (entry, interval, month) of a list that goes to every task, and parts of a key that very many captures look up.
LISTED, SALTS = 200_000, 64


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit(""))


def lookup_keys(host: str, path: str) -> Column:
    """The keys of a URL with their rank, most specific highest."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    count = lambda a: F.size(a)
    domains = F.transform(
        F.when(count(labels) > 0, F.sequence(F.lit(1), count(labels))).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.concat(F.lit("domain:"), F.array_join(F.slice(labels, count(labels) - i + 1, i), ".")).alias("key"), i.alias("rank")),
    )
    own = F.array(F.struct(F.concat(F.lit("host:"), F.col(host)).alias("key"), F.lit(1_000_000).alias("rank")))
    paths = F.transform(
        F.when(count(parts) > 0, F.sequence(F.lit(1), count(parts))).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.concat(F.lit("path:"), F.col(host), F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")).alias("key"), (i + 2_000_000).alias("rank")),
    )
    return F.when(F.col(host) != "", F.concat(domains, own, paths)).otherwise(F.array().cast("array<struct<key:string,rank:int>>"))


def validity_intervals(events: DataFrame) -> DataFrame:
    """entry, action, since, until (null: still valid); cleared spans are left out."""
    order = F.when(F.col("action") == "block", 2).when(F.col("action") == "allow", 1).otherwise(0)
    valid = events.select(F.col("entry").cast("string").alias("entry"), F.col("action").cast("string").alias("action"), F.col("dated").cast("timestamp").alias("dated")).dropna()
    moments = valid.groupBy("entry", "dated").agg(F.max_by("action", order).alias("action")).withColumn("day", F.to_date("dated"))
    days = moments.groupBy("entry", "day").agg(F.min("dated").alias("first_at"))
    next_day = days.select("entry", "day", F.lead("first_at").over(W.partitionBy("entry").orderBy("day")).alias("next_day_at"))
    within = F.lead("dated").over(W.partitionBy("entry", "day").orderBy("dated"))
    linked = moments.withColumn("next_at", within).join(next_day, ["entry", "day"])
    return linked.select("entry", "action", F.col("dated").alias("since"), F.coalesce("next_at", "next_day_at").alias("until")).where("action <> 'clear'")


def month(at: Column) -> Column:
    return (F.year(at) * 12 + F.month(at) - 1).cast("int")


def _met(keys: DataFrame, spans: DataFrame) -> DataFrame:
    """Lookups (row_no, month, k) with the intervals of their key in their month."""
    if spans.limit(LISTED + 1).count() <= LISTED:
        listed = F.broadcast(spans)
        return keys.join(listed, (keys["k.key"] == listed["entry"]) & (keys["month"] == listed["month"]))
    # Only keys that the list holds are moved.
    entries = spans.select("entry", "month").distinct()
    looked = materialize(keys.withColumns({"entry": F.col("k.key")}).join(entries, ["entry", "month"], "left_semi"), "lookups")
    counts = looked.groupBy("entry", "month").agg(F.count("*").alias("n"))
    bound = max(looked.count() // HEAVY_GROUPS, 1)
    hot = F.broadcast(materialize(counts.where(F.col("n") > bound).select("entry", "month", F.lit(True).alias("hot")), "hot_lookups"))
    salt = F.when(F.col("hot"), F.pmod(F.col("row_no"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int").alias("salt")
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = looked.join(hot, ["entry", "month"], "left").select("row_no", "fetched_at", "k", "entry", "month", salt)
    copied = spans.join(hot, ["entry", "month"], "left").withColumn("salt", F.explode(salts)).drop("hot")
    return dealt.join(copied, ["entry", "month", "salt"])


def evaluate(captures: DataFrame, events: DataFrame) -> DataFrame:
    """Every capture (page_id, url, fetched_at) with the entry that decides it and whether it is kept."""
    rows = materialize(
        captures.select(
            F.monotonically_increasing_id().alias("row_no"),
            F.col("page_id").cast("long").alias("page_id"),
            F.col("url").cast("string").alias("url"),
            F.col("fetched_at").cast("timestamp").alias("fetched_at"),
            host_of(F.col("url")).alias("host"),
            path_of(F.col("url")).alias("path"),
        ),
        "captures",
    )
    last = F.lit(rows.agg(F.max(month(F.col("fetched_at")))).first()[0]).cast("int")
    spans = validity_intervals(events).withColumn("upto", F.least(F.coalesce(month(F.col("until")), last), last)).where(month(F.col("since")) <= F.col("upto"))
    spans = materialize(spans.withColumn("month", F.explode(F.sequence(month(F.col("since")), F.col("upto")))).drop("upto"), "list_spans")
    keys = rows.select("row_no", "fetched_at", month(F.col("fetched_at")).alias("month"), F.explode(lookup_keys("host", "path")).alias("k"))
    active = (
        _met(keys, spans)
        .where((F.col("since") <= F.col("fetched_at")) & (F.col("until").isNull() | (F.col("fetched_at") < F.col("until"))))
        .groupBy("row_no")
        .agg(F.count("*").alias("n_active"), F.max_by(F.struct("entry", "action", "since"), F.struct("k.rank", "since")).alias("best"))
    )
    return rows.join(active, "row_no", "left").select(
        "page_id", "url", "host", "fetched_at", F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
        F.col("best.entry").alias("entry"), F.col("best.action").alias("action"), F.col("best.since").alias("since"),
        (F.coalesce(F.col("best.action"), F.lit("")) != "block").alias("kept"),
    )


# The tables hold neither fetch times nor lists. The query dates every page by a hash of its id and
# derives a list of events from all hosts, domains and first path parts that occur, so it grows with them.


def _number(text: str) -> str:
    return f"cast(conv(substr(md5({text}), 1, 6), 16, 10) AS BIGINT)"


def _event_selects(number, day) -> str:
    """Events of the derived list, in SQL that both engines read; ``number`` hashes, ``day`` makes a time."""
    h = number("entry")
    return f"""
        SELECT entry, 'block' AS action, {day(f"{h} % 300")} AS dated FROM entries WHERE {h} % 3 = 0
        UNION ALL SELECT entry, 'clear' AS action, {day(f"{h} % 300 + 20 + {h} % 50")} AS dated FROM entries WHERE {h} % 6 = 0
        UNION ALL SELECT entry, 'block' AS action, {day(f"{h} % 300 + 80")} AS dated FROM entries WHERE {h} % 12 = 0
        UNION ALL SELECT entry, 'allow' AS action, {day(f"{h} % 300")} AS dated FROM entries WHERE {h} % 5 = 0
        UNION ALL SELECT entry, 'allow' AS action, {day(f"{h} % 200 + 40")} AS dated FROM entries WHERE {h} % 7 = 0"""


def derived_captures(pages: DataFrame) -> DataFrame:
    minutes = F.expr(f"{_number('cast(page_id AS STRING)')} % 525600")
    return pages.select("page_id", "url", (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=minutes.cast("int"))).alias("fetched_at"))


def derived_events(pages: DataFrame) -> DataFrame:
    parts = pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).where("host <> ''")
    domain = F.concat(F.lit("domain:"), F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1))
    first = F.concat(F.lit("path:"), F.col("host"), F.regexp_extract("path", r"^(/[^/]+)", 1))
    entries = parts.select(F.explode(F.array(domain, F.concat(F.lit("host:"), F.col("host")), first)).alias("entry")).distinct()
    entries.createOrReplaceTempView("siftlark_list_entries")
    day = lambda n: f"cast('2024-01-01' AS TIMESTAMP) + make_dt_interval(cast({n} AS INT))"
    return pages.sparkSession.sql(_event_selects(_number, day).replace("FROM entries", "FROM siftlark_list_entries"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return evaluate(derived_captures(pages), derived_events(pages))


def _duck_number(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 6))::BIGINT"


ORACLE = (
    r"""
WITH parsed AS (
    SELECT page_id, url, lower(coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '')) AS host,
           coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '') AS path,
           TIMESTAMP '2024-01-01' + to_minutes(NUMBER % 525600) AS fetched_at
    FROM pages),
split AS (SELECT *, list_filter(string_split(host, '.'), lambda x: x <> '') AS labels, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM parsed),
keys AS (
    SELECT page_id, fetched_at, 'domain:' || array_to_string(labels[len(labels) - i + 1:], '.') AS key, i AS rank FROM split, range(1, 200) r(i) WHERE i <= len(labels)
    UNION ALL SELECT page_id, fetched_at, 'host:' || host, 1000000 FROM split WHERE host <> ''
    UNION ALL SELECT page_id, fetched_at, 'path:' || host || '/' || array_to_string(parts[:i], '/'), 2000000 + i FROM split, range(1, 2000) r(i) WHERE i <= len(parts) AND host <> ''),
entries AS (
    SELECT DISTINCT unnest(['domain:' || regexp_extract(host, '([^.]+\.[^.]+)$', 1), 'host:' || host, 'path:' || host || regexp_extract(path, '^(/[^/]+)', 1)]) AS entry FROM parsed WHERE host <> ''),
events AS (EVENTS),
moments AS (SELECT entry, dated, arg_max(action, CASE action WHEN 'block' THEN 2 WHEN 'allow' THEN 1 ELSE 0 END) AS action FROM events GROUP BY entry, dated),
spans AS (SELECT entry, action, dated AS since, lead(dated) OVER (PARTITION BY entry ORDER BY dated) AS until FROM moments),
active AS (
    SELECT page_id, count(*) AS n_active, arg_max({'entry': entry, 'action': action, 'since': since}, rank) AS best
    FROM keys JOIN spans ON key = entry AND since <= fetched_at AND (until IS NULL OR fetched_at < until)
    WHERE action <> 'clear' GROUP BY page_id)
SELECT page_id, url, host, fetched_at, coalesce(n_active, 0) AS n_active, best.entry AS entry, best.action AS action, best.since AS since,
       coalesce(best.action, '') <> 'block' AS kept
FROM parsed LEFT JOIN active USING (page_id)
""".replace("NUMBER", _duck_number("page_id::VARCHAR")).replace("EVENTS", _event_selects(_duck_number, lambda n: f"TIMESTAMP '2024-01-01' + to_days(({n})::INTEGER)"))
)
