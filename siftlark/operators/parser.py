"""Eligibility prose to atomic age criteria with exact character spans.

Spans are the patterns' own, in code points; Spark deals the texts, and a small reader takes each of them once. As column
expressions the same patterns were tried again by every filter and column that reads their hits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Wording that the parser recognises.
HEADER = r"(?im)^[ \t]*(?:inclusion|exclusion) criteria:?[ \t]*$"
RANGE = r"(?i)\bage\s*(?:of\s*)?(\d{1,3})\s*(?:-|to)\s*(\d{1,3})\s*years?\b"
MINIMUM = (
    r"(?i)\bage\s*(?:of\s*)?(\d{1,3})\s*years?\s*(?:or|and) older\b",
    r"(?i)\b(?:age\s*)?(?:at least|minimum age of)\s*(\d{1,3})\s*years?\b",
    r"(?i)\bage\s*(?:>=|≥)\s*(\d{1,3})\b",
)
MAXIMUM = (
    r"(?i)\bage\s*(\d{1,3})\s*years?\s*(?:or|and) younger\b",
    r"(?i)\b(?:age\s*)?(?:at most|maximum age of|no more than)\s*(\d{1,3})\s*years?\b",
    r"(?i)\bage\s*(?:<=|≤)\s*(\d{1,3})\b",
)
AMBIGUOUS = r"(?i)\b(?:and/or|unless|except|either|otherwise)\b"
SYMBOLIC = r"(?i)\bage\s*(?:>=|≥|<=|≤)\s*\d"
BOUNDS = [*[("at_least", p) for p in MINIMUM], *[("at_most", p) for p in MAXIMUM]]
PATTERNS = {p: re.compile(p) for p in (HEADER, RANGE, *MINIMUM, *MAXIMUM, AMBIGUOUS, SYMBOLIC)}
KINDS = {
    "category": pa.string(), "source_text": pa.string(), "source_start": pa.int32(), "source_end": pa.int32(), "operator": pa.string(), "years": pa.int32(),
    "review_reasons": pa.list_(pa.string()), "low": pa.bool_(), "no": pa.int32(), "o1": pa.int32(), "o2": pa.int32(),
}


class Found(NamedTuple):
    """A rule in a section: where it stands, what it says, and its place in the order of the parse."""

    start: int
    end: int
    hit: str
    operator: str
    years: int
    order: tuple[int, int, int]


def sections(text: str) -> Iterator[tuple[int, str, int, str]]:
    """Number, category, start and text of criterion sections: a header stands alone on its line; text before the first one is ignored."""
    heads = list(PATTERNS[HEADER].finditer(text))
    for no, head in enumerate(heads):
        after = head.end() + (text[head.end() : head.end() + 1] == "\n")
        upto = heads[no + 1].start() if no + 1 < len(heads) else len(text)
        yield no, "inclusion" if "inclusion" in head[0].lower() else "exclusion", after, text[after : max(after, upto)]


def rules_of(no: int, start: int, part: str) -> Iterator[Found]:
    """Ranges, and bounds that no range overlaps."""
    ranges = [m for m in PATTERNS[RANGE].finditer(part) if int(m[1]) <= int(m[2])]
    for i, m in enumerate(ranges):
        yield Found(start + m.start(), start + m.end(), m[0], "at_least", int(m[1]), (no, 0, 2 * i))
        yield Found(start + m.start(), start + m.end(), m[0], "at_most", int(m[2]), (no, 0, 2 * i + 1))
    for order, (operator, pattern) in enumerate(BOUNDS, 1):
        free = [m for m in PATTERNS[pattern].finditer(part) if not any(m.start() < r.end() and m.end() > r.start() for r in ranges)]
        for i, m in enumerate(free):
            yield Found(start + m.start(), start + m.end(), m[0], operator, int(m[1]), (no, order, i))


def parse_criteria(texts: DataFrame) -> DataFrame:
    """Age criteria of texts (doc_id, eligibility_text) with span, review reasons and confidence. A text is read once, whatever reads the columns."""

    def read(batches):
        for batch in batches:
            at, rows = [], []
            for row, text in enumerate(batch.column("eligibility_text").to_pylist()):
                for no, category, start, part in sections(text or ""):
                    for found in rules_of(no, start, part):
                        before, behind = text[: found.start].rpartition("\n")[2], text[found.end :].partition("\n")[0]
                        line = before + found.hit + behind
                        low = PATTERNS[SYMBOLIC].search(found.hit) is not None
                        told = {"ambiguous_clause": PATTERNS[AMBIGUOUS].search(before + behind), "nested_clause": "(" in line or ")" in line, "low_confidence_parse": low}
                        at.append(row)
                        rows.append((category, found.hit, found.start, found.end, found.operator, found.years, [why for why, holds in told.items() if holds], low, *found.order))
            columns = [pa.array(values, kind) for values, kind in zip(zip(*rows) if rows else [[]] * len(KINDS), KINDS.values())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), *columns], ["doc_id", *KINDS])

    id_type = texts.schema["doc_id"].dataType.simpleString()
    rows = texts.select("doc_id", "eligibility_text").mapInArrow(
        read, f"doc_id {id_type}, category string, source_text string, source_start int, source_end int, operator string, years int, review_reasons array<string>, low boolean, no int, o1 int, o2 int"
    )
    confidence = F.when(F.col("low"), F.lit("0.6000")).when(F.size("review_reasons") > 0, F.lit("0.7500")).otherwise(F.lit("1.0000")).cast("decimal(5,4)")
    return rows.withColumn("parser_confidence", confidence).withColumn("parse_order", F.struct("no", "o1", "o2")).drop("low", "no", "o1", "o2")


def span_problems(criteria: DataFrame, texts: DataFrame) -> DataFrame:
    """Criteria whose span does not give back their text."""
    both = criteria.join(texts, "doc_id")
    cut = F.substring(F.col("eligibility_text"), F.col("source_start") + 1, F.col("source_end") - F.col("source_start"))
    return both.where((F.col("source_start") < 0) | (F.col("source_end") <= F.col("source_start")) | (cut != F.col("source_text"))).select(*criteria.columns)


#: Label of this parser in stored criteria.
PARSER_VERSION = "deterministic-v1"


def gated(criteria: DataFrame, automated: bool = False) -> DataFrame:
    """Criteria with the parser's version and whether a person must see them: doubtful ones always, others unless automated use is enabled."""
    doubtful = F.size("review_reasons") > 0
    return criteria.withColumn("parser_version", F.lit(PARSER_VERSION)).withColumn("requires_human_review", doubtful | F.lit(not automated))


def manual_criteria(typed: DataFrame, texts: DataFrame) -> DataFrame:
    """Typed-in criteria with ``problem``: an unknown version, one without a text, or a span that does not give back the quoted text."""
    both = typed.join(texts.select("doc_id", "eligibility_text", F.lit(True).alias("known")), "doc_id", "left")
    cut = F.substring(F.col("eligibility_text"), F.col("source_start") + 1, F.col("source_end") - F.col("source_start"))
    wrong = (F.col("source_start") < 0) | (F.col("source_end") > F.length("eligibility_text")) | (cut != F.col("source_text"))
    problem = F.when(F.col("known").isNull(), "unknown_version").when(F.col("eligibility_text").isNull(), "no_eligibility_text").when(wrong, "span_mismatch")
    return both.withColumn("problem", problem).drop("known", "eligibility_text")
