"""Full text over all strings of a record, in the language of web searches.

Queries
- Words all have to occur; ``"several words"`` in sequence, as have the parts of one chunk (``brand#17``); ``or`` between
  two sides takes either and binds less than the words beside it; ``-`` before a chunk or phrase excludes it.
- A query without words finds nothing, and so does a side of an ``or`` that only excludes: a search never
  comes down to the whole catalogue.

The index has one row for each word of a document with its positions, in folders by hash of the word and sorted by word, so that a
search reads the files of its words; the rows of one word are dealt over files by document, however frequent it is.
Every side of a query starts from its rarest word; only documents that hold it and the second rarest are asked for the other words. If the
queries are counted to be few, the asked words of a document are gathered once for all of them. Phrases are
found by merging position lists, and matches are ranked by cover density: each shortest stretch of
words that fulfils the query counts 0.1 over one plus the other words inside it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlark.operators import retrieval
from siftlark.sources.shared import shared_path, stored, uncounted

#: Folders of the index, and documents whose rows of one word share a file.
BUCKETS, DOCS_A_FILE = 64, 2_000_000
WEIGHT = 0.1
#: Up to so many words of the queries are told to the tasks that read documents, or written into a filter on the index.
TOLD_WORDS, FILTER_WORDS = 200_000, 2_000
#: Up to so many sides of queries are told to the tasks that hold the words of whole documents.
TOLD_SIDES = 20_000
#: Words in different strings of a record never stand side by side.
STRING_GAP = 1

CHUNK = re.compile(r'(-?)"([^"]*)(?:"|\Z)|(-?)([^\s"]+)')
WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.casefold())


class Item(NamedTuple):
    """Words in sequence that have to occur, or must not."""

    excluded: bool
    words: tuple[str, ...]


def parse(text: str | None) -> list[list[Item]]:
    """The sides of a query; each is a list of items that all hold. Sides that require no word are left out."""
    chunks = [(m[1] or m[3], m[2] if m[4] is None else m[4], m[4]) for m in CHUNK.finditer(text or "")]
    sides: list[list[Item]] = [[]]
    for at, (minus, body, bare) in enumerate(chunks):
        if bare is not None and not minus and bare.lower() == "or" and sides[-1] and at + 1 < len(chunks):
            sides.append([])
            continue
        words = words_of(body)
        item = Item(bool(minus), tuple(words))
        if words and item not in sides[-1]:
            sides[-1].append(item)
    return [side for side in sides if any(not item.excluded for item in side)]


def record_strings(record: str | None) -> list[str]:
    """All string values of a JSON document; keys of an object by length, then bytes, as a binary JSON store keeps them."""
    found: list[str] = []
    try:
        left = [json.loads(record or "null")]
    except ValueError:
        return found
    while left:
        value = left.pop()
        if isinstance(value, str):
            found.append(value)
        elif isinstance(value, dict):
            left += [value[k] for k in sorted(value, key=lambda k: (len(k.encode()), k.encode()), reverse=True)]
        elif isinstance(value, list):
            left += reversed(value)
    return found


def strings_of(record: Column) -> Column:
    """``record_strings`` of a column."""

    @F.pandas_udf("array<string>")
    def read(records):
        return records.map(record_strings)

    return read(record)


def occurrences(words: tuple[str, ...], places: dict[str, list[int]]) -> list[tuple[int, int]]:
    """First and last position of each place where the words stand in sequence."""
    starts = set(places.get(words[0], ()))
    for k, word in enumerate(words[1:], 1):
        starts &= {p - k for p in places.get(word, ())}
    return [(p, p + len(words) - 1) for p in sorted(starts)]


def covers(items: list[list[tuple[int, int]]]) -> Iterator[tuple[int, int]]:
    """Shortest stretches that hold one occurrence of every item."""
    ends = sorted((end, start, no) for no, found in enumerate(items) for start, end in found)
    latest = [-1] * len(items)
    began = -1
    for at, (end, start, no) in enumerate(ends):
        latest[no] = max(latest[no], start)
        if at + 1 < len(ends) and ends[at + 1][0] == end:
            continue
        if (first := min(latest)) > began:
            began = first
            yield first, end


def cover_density(sides: list[list[Item]], places: dict[str, list[int]]) -> float | None:
    """The rank of a document with these positions of the query's words, None if it does not match."""
    stretches, words = [], set()
    for side in sides:
        if any(occurrences(item.words, places) for item in side if item.excluded):
            continue
        required = [occurrences(item.words, places) for item in side if not item.excluded]
        if all(required):
            stretches += covers(required)
            words.update(w for item in side if not item.excluded for w in item.words)
    if not stretches:
        return None
    at = sorted({p for w in words for p in places.get(w, ())})
    rank, least = 0.0, None
    for first, last in sorted(stretches, key=lambda s: (-s[0], s[1])):
        if least is not None and last >= least:
            continue  # holds a shorter one
        least = last
        inside = _count(at, first, last)
        rank += WEIGHT / (1 + (last - first) - (inside - 1))
    return rank


def _count(at: list[int], first: int, last: int) -> int:
    from bisect import bisect_left, bisect_right

    return bisect_right(at, last) - bisect_left(at, first)


# --- the index -----------------------------------------------------------------------------------


def bucket_of(word: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


def postings(documents: DataFrame, only: list[str] | None = None) -> DataFrame:
    """word, doc_id, born, gone, places: the positions of each word of a document; ``only`` those words.

    documents: doc_id, strings (or text), and ingested_at and superseded_at if searches are as of an instant.
    """
    told = None if only is None else documents.sparkSession.sparkContext.broadcast(frozenset(only))
    id_type = documents.schema["doc_id"].dataType.simpleString()

    def read(batches):
        wanted = None if told is None else told.value
        for batch in batches:
            rows, words, found = [], [], []
            for row, strings in enumerate(batch.column("strings").to_pylist()):
                places: dict[str, list[int]] = {}
                at = 0
                for text in strings or ():
                    if text is None:
                        continue
                    for word in words_of(text):
                        if wanted is None or word in wanted:
                            places.setdefault(word, []).append(at)
                        at += 1
                    at += STRING_GAP
                rows += [row] * len(places)
                words += places.keys()
                found += places.values()
            taken = [batch.column(c).take(pa.array(rows, pa.int64())) for c in ("doc_id", "born", "gone")]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *taken, pa.array(found, pa.list_(pa.int32()))], ["word", "doc_id", "born", "gone", "places"])

    instant = lambda c: (F.unix_micros(c) if c in documents.columns else F.lit(None).cast("long"))
    strings = F.col("strings") if "strings" in documents.columns else F.array("text")
    rows = documents.select("doc_id", strings.alias("strings"), instant("ingested_at").alias("born"), instant("superseded_at").alias("gone"))
    return rows.mapInArrow(read, f"word string, doc_id {id_type}, born long, gone long, places array<int>")


class TextIndex:
    """A persisted index: postings by batch and bucket, and the words of a batch with the number of its documents that hold them.

    A batch counts once its words are written, which is done last; what a failed batch left behind is never read.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets

    def append(self, documents: DataFrame) -> None:
        """Add documents that the index does not hold yet; each call adds files and rewrites none."""
        import uuid

        batch = "b" + uuid.uuid4().hex
        parts = max(1, -(-documents.count() // DOCS_A_FILE))
        found = postings(documents).select("*", bucket_of(F.col("word"), self.buckets).alias("bucket"), F.lit(batch).alias("batch"))
        # Sorted by word within a file; a word of very many documents has a file for each part of them.
        dealt = found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts))).repartition("bucket", "part").sortWithinPartitions("bucket", "word")
        dealt.drop("part").write.mode("append").partitionBy("batch", "bucket").parquet(f"{self.path}/postings")
        written = self.spark.read.schema(found.schema).parquet(f"{self.path}/postings").where(F.col("batch") == batch)
        counts = written.groupBy("batch", "bucket", "word").agg(F.count("*").alias("n_docs"))
        counts.write.mode("append").partitionBy("batch").parquet(f"{self.path}/words")

    def read(self) -> tuple[DataFrame, DataFrame]:
        """(postings, words) of the batches that are complete."""
        words = self.spark.read.parquet(f"{self.path}/words")
        complete = [r.batch for r in words.select("batch").distinct().collect()]
        held = self.spark.read.parquet(f"{self.path}/postings").where(F.col("batch").isin(complete))
        return held.drop("batch"), words.groupBy("bucket", "word").agg(F.sum("n_docs").alias("n_docs"))

    def search(self, queries: DataFrame, limit: int | None = None) -> DataFrame:
        """As ``search`` below; only files of the queries' words are read."""
        held, words = self.read()
        return _search(held, words, queries, limit, self.buckets)


def parsed_queries(queries: DataFrame) -> DataFrame:
    """query_id, as_of, sides (JSON) of queries that can find something."""
    kind = queries.schema["query_id"].dataType.simpleString()

    def read(batches):
        for batch in batches:
            sides = [json.dumps(found) if (found := parse(text)) else None for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("as_of"), pa.array(sides, pa.string())], ["query_id", "as_of", "sides"])

    as_of = F.unix_micros("as_of") if "as_of" in queries.columns else F.lit(None).cast("long")
    told = queries.select("query_id", as_of.alias("as_of"), "text").mapInArrow(read, f"query_id {kind}, as_of long, sides string")
    return told.where("sides IS NOT NULL")


def _side_words(parsed: DataFrame) -> DataFrame:
    """query_id, as_of, side, word, required: the distinct words of every side."""

    def read(batches):
        for batch in batches:
            rows = []
            for row, text in enumerate(batch.column("sides").to_pylist()):
                for side, items in enumerate(json.loads(text)):
                    required = {w for excluded, words in items if not excluded for w in words}
                    rows += [(row, side, w, w in required) for w in {w for _, words in items for w in words}]
            at = pa.array([r[0] for r in rows], pa.int64())
            columns = [batch.column(c).take(at) for c in ("query_id", "as_of")]
            columns += [pa.array([r[k] for r in rows], t) for k, t in ((1, pa.int32()), (2, pa.string()), (3, pa.bool_()))]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", "as_of", "side", "word", "required"])

    kind = parsed.schema["query_id"].dataType.simpleString()
    return parsed.mapInArrow(read, f"query_id {kind}, as_of long, side int, word string, required boolean")


def _small(side: DataFrame) -> DataFrame:
    """``side`` marked for broadcast if it was counted to be small, else kept from it."""
    return F.broadcast(side) if side.limit(retrieval.BROADCAST_ROWS + 1).count() <= retrieval.BROADCAST_ROWS else uncounted(side)


def _search(held: DataFrame, words: DataFrame, queries: DataFrame, limit: int | None, buckets: int) -> DataFrame:
    # Queries that ask the same at the same instant are searched once.
    given = stored(parsed_queries(queries), "parsed_queries")
    once = stored(given.select("as_of", "sides").distinct().withColumn("asked_id", F.monotonically_increasing_id()), "distinct_queries")
    parsed = once.withColumnRenamed("asked_id", "query_id")
    asked = stored(_side_words(parsed).withColumn("bucket", bucket_of(F.col("word"), buckets)), "asked_words")
    distinct = asked.select("bucket", "word").distinct()
    known = stored(words.join(_small(distinct), ["bucket", "word"]), "known_words")
    if known.limit(FILTER_WORDS + 1).count() <= FILTER_WORDS:
        rows = known.select("bucket", "word").collect()
        held = held.where(F.col("bucket").isin(sorted({r.bucket for r in rows})) & F.col("word").isin([r.word for r in rows]))
    # Sides that lack a required word find nothing; the others start from their rarest one.
    counted = asked.join(_small(known), ["bucket", "word"], "left")
    order = F.when(F.col("required"), F.struct("n_docs", "word", "bucket"))
    rare = F.array_sort(F.collect_list(order))
    starts = counted.groupBy("query_id", "as_of", "side").agg(rare.alias("rare"), F.bool_or(F.col("required") & F.col("n_docs").isNull()).alias("hopeless"))
    starts = stored(starts.where(~F.col("hopeless")).select("query_id", "as_of", "side", F.get("rare", F.lit(0)).alias("rarest"), F.get("rare", F.lit(1)).alias("second")), "rarest_words")
    if starts.limit(TOLD_SIDES + 1).count() <= TOLD_SIDES:
        ranked = _searched_by_document(held.join(_small(known.select("bucket", "word")), ["bucket", "word"], "left_semi"), starts, parsed)
    else:
        ranked = _searched_by_word(held, starts, asked, parsed)
    ranked = retrieval.ranked(ranked, limit, "cover_rank") if limit is not None else ranked
    named = given.join(_small(once), given["sides"].eqNullSafe(once["sides"]) & given["as_of"].eqNullSafe(once["as_of"])).select(given["query_id"], "asked_id")
    return ranked.withColumnRenamed("query_id", "asked_id").join(_small(named), "asked_id").select("query_id", *[c for c in ranked.columns if c != "query_id"])


def _searched_by_document(held: DataFrame, starts: DataFrame, parsed: DataFrame) -> DataFrame:
    """query_id, doc_id, cover_rank of few enough queries to be told to every task: the asked words of a document meet once, for all of them."""
    begin: dict[str, list[tuple]] = {}
    told = F.broadcast(starts).join(parsed.select("query_id", "sides"), "query_id").select("query_id", "as_of", "sides", F.col("rarest.word").alias("word"), F.col("second.word").alias("second")).collect()
    for r in told:
        begin.setdefault(r["word"], []).append((r["query_id"], r["as_of"], r["second"]))
    sent = held.sparkSession.sparkContext.broadcast((begin, {r["query_id"]: r["sides"] for r in told}))

    def read(batches):
        begin, texts = sent.value
        known: dict[int, list[list[Item]]] = {}
        for batch in batches:
            rows: list[int] = []
            queries: list[int] = []
            ranks: list[float] = []
            words, places, born, gone = (batch.column("found").flatten().field(c).to_pylist() for c in ("word", "places", "born", "gone"))
            ends = pc.list_value_length(batch.column("found")).to_pylist()
            end = 0
            for row, n in enumerate(ends):
                at, end = end, end + n
                here = dict(zip(words[at:end], places[at:end]))
                wanted = set()
                for k in range(at, end):
                    for query, as_of, second in begin.get(words[k], ()):
                        if (second is None or second in here) and (as_of is None or (born[k] is not None and born[k] <= as_of and (gone[k] is None or gone[k] > as_of))):
                            wanted.add(query)
                for query in wanted:
                    if query not in known:
                        known[query] = [[Item(e, tuple(w)) for e, w in side] for side in json.loads(texts[query])]
                    rank = cover_density(known[query], here)
                    if rank is not None:
                        rows.append(row)
                        queries.append(query)
                        ranks.append(round(rank, 9))
            docs = batch.column("doc_id").take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(queries, pa.int64()), docs, pa.array(ranks, pa.float64())], ["query_id", "doc_id", "cover_rank"])

    doc = held.schema["doc_id"].dataType.simpleString()
    whole = held.groupBy("doc_id").agg(F.collect_list(F.struct("word", "places", "born", "gone")).alias("found"))
    # Written once, so that the rows are ranked and handed to all who ask the same from what was found.
    return stored(whole.mapInArrow(read, f"query_id long, doc_id {doc}, cover_rank double"), "text_candidates")


def _searched_by_word(held: DataFrame, starts: DataFrame, asked: DataFrame, parsed: DataFrame) -> DataFrame:
    """The same for any number of queries, by joins on the words."""
    seen = F.col("as_of").isNull() | ((F.col("born") <= F.col("as_of")) & (F.col("gone").isNull() | (F.col("gone") > F.col("as_of"))))
    first = held.join(_small(starts.select("query_id", "as_of", "side", "second", "rarest.bucket", "rarest.word")), ["bucket", "word"]).where(seen)
    first = first.select("query_id", "side", "doc_id", "second")
    # Documents that lack the second rarest word as well are asked for no other.
    both = first.where("second IS NOT NULL").select("query_id", "side", "doc_id", "second.bucket", "second.word").join(uncounted(held.select("bucket", "word", "doc_id")), ["bucket", "word", "doc_id"], "left_semi")
    candidates = stored(first.where("second IS NULL").select("query_id", "side", "doc_id").unionByName(both.select("query_id", "side", "doc_id")), "text_candidates")
    sought = candidates.join(_small(asked.select("query_id", "side", "bucket", "word")), ["query_id", "side"]).select("query_id", "doc_id", "bucket", "word").distinct()
    sought = stored(sought, "sought_words")
    found = held.select("bucket", "word", "doc_id", "places").join(_small(sought), ["bucket", "word", "doc_id"])
    grouped = found.groupBy("query_id", "doc_id").agg(F.collect_list(F.struct("word", "places")).alias("places"))
    return _densities(grouped.join(_small(parsed.select("query_id", "sides")), "query_id"))


def _densities(rows: DataFrame) -> DataFrame:
    """query_id, doc_id, cover_rank of the rows (query_id, doc_id, places, sides) that match."""

    def read(batches):
        known: dict[str, list[list[Item]]] = {}
        for batch in batches:
            ranks = []
            for text, places in zip(batch.column("sides").to_pylist(), batch.column("places").to_pylist()):
                if text not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[text] = [[Item(e, tuple(w)) for e, w in side] for side in json.loads(text)]
                rank = cover_density(known[text], {p["word"]: p["places"] for p in places})
                ranks.append(None if rank is None else round(rank, 9))
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("doc_id"), pa.array(ranks, pa.float64())], ["query_id", "doc_id", "cover_rank"])

    query, doc = (rows.schema[c].dataType.simpleString() for c in ("query_id", "doc_id"))
    return rows.select("query_id", "doc_id", "sides", "places").mapInArrow(read, f"query_id {query}, doc_id {doc}, cover_rank double").where("cover_rank IS NOT NULL")


def search(documents: DataFrame, queries: DataFrame, limit: int | None = None) -> DataFrame:
    """query_id, doc_id and cover_rank (and rank, with a ``limit``) of all matches, without an index of all words.

    queries: query_id, text and, for documents as of an instant, as_of. Ties (to nine decimals) go to the smaller id. The
    documents are read once, for the words of the queries only if those are counted to be few enough to be told to every task.
    """
    parsed = stored(_side_words(parsed_queries(queries)).select("word").distinct(), "query_words")
    only = [r.word for r in parsed.collect()] if parsed.limit(TOLD_WORDS + 1).count() <= TOLD_WORDS else None
    held = stored(postings(documents, only).withColumn("bucket", bucket_of(F.col("word"), BUCKETS)), "postings")
    return _search(held, held.groupBy("bucket", "word").agg(F.count("*").alias("n_docs")), queries, limit, BUCKETS)


def new_index(spark: SparkSession, documents: DataFrame, buckets: int = BUCKETS) -> TextIndex:
    """An index of ``documents`` in the shared folder."""
    index = TextIndex(spark, shared_path(spark, "text_index"), buckets)
    index.append(documents)
    return index
