"""The best documents of very many short queries by field score, without a row for every query and document that match (Q3).

Work grows with documents and with what is kept, not with their product. Documents that the same terms hit in the same fields tie in
every query, so they form one class. For every set of terms (up to ``MOST_TERMS``) the best classes that all of them hit are kept, as
many as hold ``limit`` documents. A document among the best of a query is among the best of exactly those terms of the query that hit
it: whatever goes before it there goes before it in the query as well. So the lists of a query's sets of terms hold all its results, and
only those lists count whose scores reach the one at which some list of the query has ``limit`` documents.

Queries with more terms or a repeated one, and documents that more than ``MOST_HITS`` terms hit, are left to the plain join.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlark.sources.shared import stored

#: Terms of a query, and hits of a document, whose sets are listed.
MOST_TERMS, MOST_HITS = 5, 8


def _masks(size: int) -> list[int]:
    return [m for m in range(1, 1 << size) if m.bit_count() <= MOST_TERMS]


def _sets(rows: DataFrame, weights: list[int] | None = None) -> DataFrame:
    """(id, terms, key, mask, score): every set of the terms (ids in ascending order; with ``weights``, id and place of a field) of each row."""
    masks = [_masks(n) for n in range(MOST_HITS + 1)]

    def read(batches):
        for batch in batches:
            at, keys, chosen, scores = [], [], [], []
            for row, terms in enumerate(batch.column("terms").to_pylist()):
                names = [str(t["tid"]) for t in terms]
                worth = [0 if weights is None else weights[t["field"]] for t in terms]
                key, score = [""], [0]
                for m in range(1, 1 << len(terms)):
                    high = m.bit_length() - 1
                    rest = m ^ (1 << high)
                    key.append(f"{key[rest]},{names[high]}")
                    score.append(score[rest] + worth[high])
                for m in masks[len(terms)]:
                    at.append(row)
                    keys.append(key[m])
                    chosen.append(m)
                    scores.append(score[m])
            rest = [batch.column(c).take(pa.array(at, pa.int64())) for c in carried]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(keys, pa.string()), pa.array(chosen, pa.int32()), pa.array(scores, pa.int32())], [*carried, "key", "mask", "score"])

    carried = [c for c in rows.columns if c != "terms"]
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in carried)
    return rows.mapInArrow(read, f"{kinds}, key string, mask int, score int")


def split_hits(hits: DataFrame, asked: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(documents, queries, hits for the plain join if there are any).

    hits: doc_id, term_text, field; asked: query_id, pos, term_text, fact_id. documents: doc_id, terms (array of tid and field) of those with few hits;
    queries: query_id, terms (array of tid), listed (array of pos, fact_id, tid) of those with few terms.
    """
    numbers = stored(asked.select("term_text").distinct().withColumn("tid", F.monotonically_increasing_id()), "term_numbers")
    place = F.coalesce(*[F.when(F.col("field") == f, F.lit(i)) for i, f in enumerate(order)])
    struct = F.struct("tid", place.alias("field"), "term_text")
    signed = stored(hits.join(numbers, "term_text").groupBy("doc_id").agg(F.array_sort(F.collect_list(struct)).alias("terms")), "document_terms")
    distinct = F.size(F.array_distinct(F.transform("terms", lambda t: t["tid"]))) == F.size("terms")
    few = (F.size("terms") <= MOST_HITS) & distinct & F.col("doc_id").isNotNull()
    documents = signed.where(few).select("doc_id", F.transform("terms", lambda t: F.struct(t["tid"].alias("tid"), t["field"].alias("field"))).alias("terms"))

    numbered = stored(asked.join(numbers, "term_text"), "numbered_terms")
    held = numbered.groupBy("query_id").agg(F.count("*").alias("n"), F.count_distinct("tid").alias("n_distinct"))
    short = stored(held.withColumn("short", (F.col("n") == F.col("n_distinct")) & (F.col("n") <= MOST_TERMS)), "query_sizes")
    marked = numbered.join(short.select(F.col("query_id").alias("of"), "short"), F.col("query_id").eqNullSafe(F.col("of"))).drop("of")
    queries = marked.where("short").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("pos", "fact_id", "tid"))).alias("listed"))
    queries = queries.withColumn("terms", F.array_sort(F.transform("listed", lambda t: F.struct(t["tid"].alias("tid")))))

    wide, long = signed.where(~few), short.where("NOT short")
    rest = None
    if not wide.isEmpty():
        flat = wide.select("doc_id", F.explode("terms").alias("t")).select("doc_id", F.col("t.term_text").alias("term_text"), F.col("t.field").alias("place"))
        rest = flat.join(asked, "term_text")
    if not long.isEmpty():
        flat = signed.where(few).select("doc_id", F.explode("terms").alias("t")).select("doc_id", F.col("t.term_text").alias("term_text"), F.col("t.field").alias("place"))
        part = flat.join(marked.where("NOT short").select("query_id", "pos", "term_text", "fact_id"), "term_text")
        rest = part if rest is None else rest.unionByName(part)
    if rest is not None:
        rest = rest.withColumn("field", F.element_at(F.array(*[F.lit(f) for f in order]), F.col("place") + 1)).drop("place")
    return documents, queries, rest


def best(documents: DataFrame, queries: DataFrame, weights: list[int], limit: int) -> DataFrame:
    """query_id, doc_id, score, hit (array of tid and field), listed: the best ``limit`` of these documents for each of these queries; tables as of ``split_hits``."""
    within = W.partitionBy("terms").orderBy("doc_id")
    members = documents.withColumn("no", F.row_number().over(within)).where(F.col("no") <= limit)
    classes = members.groupBy("terms").agg(F.sort_array(F.collect_list("doc_id")).alias("docs")).withColumn("cid", F.monotonically_increasing_id())
    classes = stored(classes, "term_classes")
    listed = _sets(classes.select("cid", F.get("docs", F.lit(0)).alias("first"), F.size("docs").alias("n"), "terms"), weights)
    by = W.partitionBy("key").orderBy(F.desc("score"), "first")
    lists = listed.withColumn("no", F.row_number().over(by)).where(F.col("no") <= limit)
    lists = lists.withColumn("upto", F.sum("n").over(by.rowsBetween(W.unboundedPreceding, 0)))
    lists = stored(lists.withColumn("enough", F.when(F.col("upto") >= limit, F.col("score"))).drop("no", "upto"), "term_lists")
    tops = lists.groupBy("key").agg(F.max("score").alias("top"), F.max("enough").alias("enough"))

    sets = stored(queries.select("terms").distinct().withColumn("sid", F.monotonically_increasing_id()), "term_sets")
    subsets = _sets(sets.select("sid", "terms")).select("sid", "key").join(tops, "key")
    least = subsets.groupBy("sid").agg(F.coalesce(F.max("enough"), F.lit(0)).alias("least"))
    wanted = subsets.join(least, "sid").where("top >= least").select("sid", "key", "least")
    rows = wanted.join(lists.select("key", "cid", "mask", "score", "n"), "key").where("score >= least")
    # The set of all terms that hit is the one of highest score.
    whole = rows.groupBy("sid", "cid", "n").agg(F.max(F.struct("score", "mask")).alias("x"))
    higher = W.partitionBy("sid").orderBy(F.desc("score")).rangeBetween(W.unboundedPreceding, W.currentRow)
    whole = whole.select("sid", "cid", "n", "x.score", "x.mask").withColumn("upto", F.sum("n").over(higher))
    level = W.partitionBy("sid", "score")
    # A score is needed as long as higher ones hold fewer documents than the limit.
    whole = whole.withColumn("before", F.col("upto") - F.sum("n").over(level)).where(F.col("before") < limit)
    bits = F.expr("filter(terms, (t, i) -> (shiftright(mask, i) & 1) = 1)")
    held = whole.join(classes, "cid").select("sid", F.explode("docs").alias("doc_id"), "score", bits.alias("hit"))
    by_set = W.partitionBy("sid").orderBy(F.desc("score"), "doc_id")
    held = held.withColumn("rank", F.row_number().over(by_set)).where(F.col("rank") <= limit)
    asking = queries.join(sets, "terms").select("sid", "query_id", "listed")
    return held.join(asking, "sid").select("query_id", "doc_id", F.col("score").cast("double").alias("score"), "hit", "listed")
