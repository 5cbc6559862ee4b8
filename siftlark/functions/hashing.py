"""Identity hashes (H1-H5)."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def canonical_json(document: str | None) -> str | None:
    """Sorted keys, compact separators, ASCII escapes."""
    if document is None:
        return None
    return json.dumps(json.loads(document), sort_keys=True, separators=(",", ":"), ensure_ascii=True)


@F.pandas_udf(StringType())
def _hash_any(documents: pd.Series) -> pd.Series:
    return documents.map(lambda d: None if d is None else hashlib.sha256(canonical_json(d).encode()).hexdigest())


def canonical_hash(documents: Column) -> Column:
    """SHA-256 of the canonical form of JSON documents.

    A variant keeps the fields of an object in the order of their names and is written without blanks. So documents of printable ASCII
    without escapes, whose numbers are integers of a common size, never leave the JVM; all others (fractions, escapes, other
    letters, repeated names) go through Python's JSON, which sees nulls in place of the first.
    """
    parsed = F.try_parse_json(documents)
    plain = documents.rlike(r"^[\t\n\r\x20-\x5B\x5D-\x7E]*$") & ~documents.rlike(r"[0-9][.eE]|-0|[0-9]{18}") & parsed.isNotNull()
    return F.coalesce(F.when(plain, F.sha2(F.to_json(parsed), 256)), _hash_any(F.when(~F.coalesce(plain, F.lit(False)), documents)))


def fact_id(import_id: Column, resource_type: Column, resource_id: Column, name: Column) -> Column:
    return F.concat_ws(":", import_id, resource_type, resource_id, name)


def content_hash(*columns: Column) -> Column:
    """SHA-256 of scalar columns joined by a unit separator; for keys, not for JSON documents."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(c.cast("string"), F.lit("\u0000")) for c in columns]), 256)
