"""Text functions as column expressions."""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that the corpus-scale token baseline leaves out.
STOP_WORDS = [
    "about", "after", "before", "being", "between", "because", "could", "during", "from", "have", "into", "patient", "patients", "should",
    "that", "their", "there", "these", "they", "this", "through", "with", "without", "would",
]

REDACTED = "[REDACTED]"
REDACTED_CONTENT = "[REDACTED: FHIR content]"
# What counts as an address, a phone number, a social security number and serialised records.
EMAIL = r"\b[^\s@]+@[^\s@]+\.[^\s@]+\b"
PHONE = r"(?<!\w)(?:\+?\d{1,3}[-.\s]?)?(?:\(?\d{2,3}\)?[-.\s]?)?\d{3}[-.\s]\d{4}(?!\w)"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
# What every match of a phone number or of the SSN form holds.
PHONE_CORE, SSN_CORE = r"\d{3}[-.\s]\d{4}", r"\d{3}-\d{2}-\d{4}"
RECORD = r"(?i)([\"']resourceType[\"']\s*:|<\s*(?:Bundle|Patient|Observation|Condition)\b)"

# Members of character classes that mean to Java what the short forms mean to Python on Unicode text.
_CLASSES = {"w": r"\p{L}\p{N}_", "d": r"\p{Nd}", "s": r"\t-\r\x1c-\x20\x85\xa0  -     　"}
_WORD = f"[{_CLASSES['w']}]"
_EDGE = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def java(pattern: str) -> str:
    """A Python pattern for Spark: Unicode classes and word edges, case folding beyond ASCII, \n as the only line end."""
    out, inside, at = [], False, 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            name = pattern[at + 1]
            if name in _CLASSES:
                out.append(_CLASSES[name] if inside else f"[{_CLASSES[name]}]")
            else:
                out.append(_EDGE if name == "b" and not inside else c + name)
            at += 2
            continue
        inside = c == "[" or (inside and c != "]")
        out.append(c)
        at += 1
    return "(?ud)" + "".join(out)


SPACES = java(r"\s+")


@functools.cache
def _digits() -> tuple[str, str]:
    """All decimal digits beyond ASCII, and what they stand for."""
    found = [c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"]
    return "".join(found), "".join(str(unicodedata.decimal(c)) for c in found)


def number(text: Column) -> Column:
    """The whole number that a text of decimal digits of any script stands for."""
    return F.translate(text, *_digits()).cast("int")


@functools.cache
def _folds() -> tuple[dict[str, str], dict[str, str]]:
    """Letters that fold to one character, and those that fold to several."""
    found = {c: c.casefold() for c in map(chr, range(128, sys.maxunicode + 1)) if not "\ud800" <= c < "\ue000" and c.casefold() != c}
    return {c: f for c, f in found.items() if len(f) == 1}, {c: f for c, f in found.items() if len(f) > 1}


def casefold(text: Column) -> Column:
    """Full Unicode case folding: lower case for ASCII text, else by the table of folds."""
    single, several = _folds()
    one = F.translate(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "".join(single), "".join(single.values()))
    table = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])
    each = F.array_join(F.transform(F.split(one, ""), lambda c: F.coalesce(F.element_at(table, c), c)), "")
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).when(text.rlike(f"[{''.join(several)}]"), each).otherwise(one)


def collapse(text: Column) -> Column:
    """Runs of Unicode white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def normalize(text: Column) -> Column:
    """Case-folded, white space collapsed, trimmed."""
    return collapse(casefold(text))


def joined(values: Column) -> Column:
    """Normalised values of an array in one string; nulls are skipped."""
    return F.array_join(F.transform(F.coalesce(values, F.array().cast("array<string>")), normalize), " ")


def words(text: Column) -> Column:
    """Unicode word tokens in order."""
    return F.regexp_extract_all(text, F.lit(java(r"\w+")), F.lit(0))


def has_word_sequence(text: Column, term: Column) -> Column:
    """Whether the term's words occur in the text as a contiguous run; an empty term never does."""
    return (F.size(words(term)) > 0) & F.contains(padded(text), padded(term))


def padded(text: Column) -> Column:
    """Normalised words, each between blanks, so that a run of words is a substring."""
    return F.concat(F.lit(" "), F.array_join(words(normalize(text)), " "), F.lit(" "))


def token_set(text: Column) -> Column:
    """Distinct corpus tokens without stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z][a-z0-9-]{2,}"), F.lit(0))
    return F.array_except(F.array_distinct(found), F.array(*[F.lit(w) for w in STOP_WORDS]))


def distinct_join(values: Column, separator: str = " ") -> Column:
    """Values in first-seen order without repeats, joined."""
    return F.array_join(F.array_distinct(values), separator)


def first_non_blank(*values: Column) -> Column:
    return F.coalesce(*[F.when(F.trim(v) != "", v) for v in values])


def filter_values(values: Column) -> Column:
    """White space collapsed, blanks dropped, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(values, collapse), lambda v: v != "")))


def redact(text: Column) -> Column:
    """Serialised records give one constant; else addresses, then phone numbers, then numbers of the SSN form go.

    Each pattern is tried only on texts that hold what no match can do without.
    """
    hidden = text
    for pattern, needed in ((EMAIL, F.contains(text, F.lit("@"))), (PHONE, text.rlike(java(PHONE_CORE))), (SSN, text.rlike(java(SSN_CORE)))):
        hidden = F.when(needed, F.regexp_replace(hidden, java(pattern), REDACTED)).otherwise(hidden)
    record = F.when(text.rlike(r"(?iu)resourceType|<"), text.rlike(java(RECORD))).otherwise(F.lit(False))
    return F.when(record, F.lit(REDACTED_CONTENT)).otherwise(hidden)
