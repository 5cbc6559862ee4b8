"""Which terms a text holds as substrings, without a nested loop.

All distinct terms become one Aho-Corasick automaton per worker, which reads a text once however many terms there are. The terms
are counted first: up to ``TERMS_A_PASS`` at a time are told to the tasks, and more are taken in passes over the texts, each
written before the next one starts. What comes out joins the queries' terms by term, an equi-join.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlark.sources.shared import stored

TERMS_A_PASS = 200_000

_automata: dict[str, object] = {}


def automaton(terms: list[str], key: str):
    """One automaton per worker and pass, kept across its tasks; a worker keeps the last one only."""
    import ahocorasick

    if key not in _automata:
        made = ahocorasick.Automaton()
        for term in terms:
            made.add_word(term, term)
        made.make_automaton()
        _automata.clear()
        _automata[key] = made
    return _automata[key]


def terms_in(texts: DataFrame, terms: DataFrame, fields: list[str]) -> DataFrame:
    """doc_id, term, field: the first of ``fields`` that holds each term, for every row of ``texts`` (doc_id, fields).

    ``terms`` (term) may repeat; null and empty ones are in no text, null texts hold none.
    """
    wanted = stored(terms.select(F.col("term").cast("string").alias("term")).where("term <> ''").distinct(), "terms")
    passes = max(1, -(-wanted.count() // TERMS_A_PASS))
    if passes > 1:
        wanted = stored(wanted.withColumn("pass", F.pmod(F.xxhash64("term"), F.lit(passes))), "terms_by_pass")
    kind = texts.schema["doc_id"].dataType.simpleString()
    found = None
    for number in range(passes):
        part = wanted if passes == 1 else wanted.where(F.col("pass") == number)
        sent, key = texts.sparkSession.sparkContext.broadcast([r.term for r in part.select("term").collect()]), uuid.uuid4().hex

        def scan(batches: Iterator[pa.RecordBatch], sent=sent, key=key) -> Iterator[pa.RecordBatch]:
            terms = sent.value
            machine = automaton(terms, key) if terms else None
            for batch in batches:
                rows, words, places = [], [], []
                columns = [batch.column(f).to_pylist() for f in fields]
                for row in range(batch.num_rows if terms else 0):
                    first: dict[str, str] = {}
                    for name, column in zip(fields, columns):
                        for _, term in machine.iter(column[row] or ""):
                            first.setdefault(term, name)
                    rows += [row] * len(first)
                    words += first.keys()
                    places += first.values()
                taken = batch.column("doc_id").take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([taken, pa.array(words, pa.string()), pa.array(places, pa.string())], ["doc_id", "term", "field"])

        hits = texts.select("doc_id", *fields).mapInArrow(scan, f"doc_id {kind}, term string, field string")
        hits = stored(hits, "term_hits") if passes > 1 else hits
        found = hits if found is None else found.unionByName(hits)
    return found
