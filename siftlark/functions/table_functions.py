"""Table functions for SQL (2.13): ``zip_members`` and ``parse_eligibility``.

``register`` makes them known to a session. Both go with ``LATERAL`` over a table of paths or of texts; ``parse_eligibility_of`` takes a whole
table (doc_id, eligibility_text) as its argument and reads it by Arrow batches, which ``LATERAL`` does not allow.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from siftlark.operators.parser import AMBIGUOUS, HEADER, MAXIMUM, MINIMUM, RANGE, SYMBOLIC

MEMBERS = "member_no long, member string, content string"
CRITERIA = "category string, source_text string, source_start int, source_end int, operator string, years int, review_reasons array<string>, parser_confidence double"
CRITERION_FIELDS = pa.schema(
    [("category", pa.string()), ("source_text", pa.string()), ("source_start", pa.int32()), ("source_end", pa.int32()), ("operator", pa.string()), ("years", pa.int32()),
     ("review_reasons", pa.list_(pa.string())), ("parser_confidence", pa.float64())]
)

def criteria_of(text: str | None) -> Iterator[tuple]:
    """Age criteria of one text, in the order in which ``parser.parse_criteria`` finds them."""
    text = text or ""
    heads = list(re.finditer(HEADER, text))
    for head, following in zip(heads, [*heads[1:], None]):
        category = "inclusion" if "inclusion" in head[0].lower() else "exclusion"
        begin = head.end() + (text[head.end() : head.end() + 1] == "\n")
        section = text[begin : following.start() if following else len(text)]
        ranges = [m for m in re.finditer(RANGE, section) if int(m[1]) <= int(m[2])]
        found = [(m, operator, int(m[k])) for m in ranges for k, operator in ((1, "at_least"), (2, "at_most"))]
        for operator, pattern in [("at_least", p) for p in MINIMUM] + [("at_most", p) for p in MAXIMUM]:
            single = [m for m in re.finditer(pattern, section) if not any(m.start() < r.end() and m.end() > r.start() for r in ranges)]
            found += [(m, operator, int(m[1])) for m in single]
        for m, operator, years in found:
            start, end = begin + m.start(), begin + m.end()
            before, behind = text[:start].rpartition("\n")[2], text[end:].partition("\n")[0]
            low = re.search(SYMBOLIC, m[0]) is not None
            line = before + m[0] + behind
            told = (("ambiguous_clause", re.search(AMBIGUOUS, before + behind)), ("nested_clause", "(" in line or ")" in line), ("low_confidence_parse", low))
            reasons = [name for name, holds in told if holds]
            yield category, m[0], start, end, operator, years, reasons, 0.6 if low else 0.75 if reasons else 1.0


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


class ParseEligibility:
    """Criteria of one text."""

    def eval(self, text: str | None) -> Iterator[tuple]:
        yield from criteria_of(text)


class ParseEligibilityOf:
    """Criteria of a table of texts, each with its doc_id as text."""

    def eval(self, texts: pa.RecordBatch) -> Iterator[pa.Table]:
        rows = [(None if i is None else str(i), *row) for i, t in zip(texts.column("doc_id").to_pylist(), texts.column("eligibility_text").to_pylist()) for row in criteria_of(t)]
        yield _table(rows, pa.schema([("doc_id", pa.string()), *CRITERION_FIELDS]))


class ZipMembers:
    """member_no, member and content of the members of one archive whose name ends as asked, read one after the other through Arrow's file systems."""

    def eval(self, path: str | None, suffix: str | None) -> Iterator[tuple]:
        from pyarrow import fs

        if path is None:
            return
        store, name = fs.FileSystem.from_uri(path)
        with zipfile.ZipFile(store.open_input_file(name)) as source:
            for number, member in enumerate(x for x in source.namelist() if x.endswith(suffix or "")):
                yield number, member, source.read(member).decode("utf-8")


def register(spark: SparkSession) -> None:
    spark.udtf.register("zip_members", F.udtf(ZipMembers, returnType=MEMBERS))
    spark.udtf.register("parse_eligibility", F.udtf(ParseEligibility, returnType=CRITERIA))
    spark.udtf.register("parse_eligibility_of", F.arrow_udtf(ParseEligibilityOf, returnType="doc_id string, " + CRITERIA))
