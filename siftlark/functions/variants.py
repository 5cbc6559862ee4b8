"""Typed reads from VARIANT values: a field of another JSON type counts as absent, never as converted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def kind(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, a number type, VOID; null if absent."""
    return F.regexp_extract(F.schema_of_variant(value), r"^(\w+)", 1)


def _only(found: Column, fits, taken) -> Column:
    """``taken`` of a value that ``fits``, else null. The value is found once, however often both look at it."""
    return F.get(F.transform(F.filter(F.array(found), fits), taken), F.lit(0))


def text(value: Column, path: str) -> Column:
    """A JSON string that is not blank, as it stands."""
    string = _only(at(value, path), lambda v: F.schema_of_variant(v) == "STRING", lambda v: F.try_variant_get(v, "$", "string"))
    return _only(string, lambda s: F.trim(s) != "", lambda s: s)


def number(value: Column, path: str) -> Column:
    """A JSON number; booleans and numerals in strings are none."""
    return _only(at(value, path), lambda v: kind(v).isin("BIGINT", "DOUBLE", "FLOAT", "DECIMAL", "INT"), lambda v: F.try_variant_get(v, "$", "double"))


def items(value: Column, path: str) -> Column:
    """Elements of a JSON array; empty if there is none. Nothing but an array can be read as one."""
    return F.coalesce(F.try_variant_get(value, path, "array<variant>"), F.array().cast("array<variant>"))
