"""Text functions against Python's own on text beyond ASCII and on other line ends."""

import json
import random
import re

import pytest

from siftlark.functions import text as T
from siftlark.operators import parser, redaction

SPECIAL = "aZ5 9-.éßſﬁΣσςİıẞᎠꭰ٣²́  \x1c\x85\r\n　_@(+ǅΐ\U00010400"


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(4)
    found = ["".join(draw.choices(SPECIAL, k=draw.randint(0, 30))) for _ in range(400)]
    return found + ["é555-1234 x", "555 1234", "x ٣٣٣-٣٣٣٣", "a@b.c", "ä@ö.ü", "123-45-6789", "ıIİ", "ΣΣ", ""]


def run(spark, texts, make):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", make("text")).collect()
    return [r[1] for r in sorted(rows)]


def test_normalize_is_casefold(spark, texts):
    from pyspark.sql import functions as F

    whole = [*texts, *[chr(c) for c in range(1, 0x3000)], *[chr(c) for c in range(0xA000, 0xAC00)], *[chr(c) for c in range(0xFB00, 0xFB20)]]
    found = run(spark, whole, lambda c: T.normalize(F.col(c)))
    assert [(t, f) for t, f in zip(whole, found) if f != " ".join(t.casefold().split())] == []


def test_words(spark, texts):
    from pyspark.sql import functions as F

    assert run(spark, texts, lambda c: T.words(F.col(c))) == [re.findall(r"\w+", t) for t in texts]


def test_redact(spark, texts):
    from pyspark.sql import functions as F

    assert run(spark, texts, lambda c: T.redact(F.col(c))) == [redaction.clean_text(t) for t in texts]


@pytest.mark.parametrize(
    "body, found",
    [
        ("Inclusion criteria:\nage at least 18 years", [("age at least 18 years", 18)]),
        ("Inclusion criteria:\r\nage at least 18 years", []),
        ("Inclusion criteria:\nage at least 18 years", [("age at least 18 years", 18)]),
        ("Inclusion criteria: age at least 18 years", []),
        ("Inclusion criteria:\nAGE ≥ ١٨", [("AGE ≥ ١٨", 18)]),
        ("Inclusion criteria:\nage 18 to 65 years and age >= 20", [("age 18 to 65 years", 18), ("age 18 to 65 years", 65), ("age >= 20", 20)]),
    ],
)
def test_parser_line_ends_and_blanks(spark, body, found):
    rows = parser.parse_criteria(spark.createDataFrame([(1, body)], "doc_id int, eligibility_text string")).collect()
    assert sorted((r.source_text, r.years) for r in rows) == found
    assert all(body[r.source_start : r.source_end] == r.source_text for r in rows)


def test_fields_of_nested_json():
    body = {"a": ["x@y.zz", ["123-45-6789", {"Patient-Id": 1}]], "lab_value": {"b": 2}, "collaborator": "ok", "n": 5, "deep": {"Note": [1], "free": "555-1234"}}
    assert json.loads(redaction.redact_document(json.dumps(body))) == {
        "a": ["[REDACTED]", ["[REDACTED]", {"Patient-Id": "[REDACTED]"}]], "lab_value": "[REDACTED]", "collaborator": "ok", "n": 5, "deep": {"Note": "[REDACTED]", "free": "[REDACTED]"},
    }
    assert redaction.redact_document('"x@y.zz"') == '"[REDACTED]"' and redaction.redact_document(None) is None


def test_canonical_hash_is_the_same_inside_and_outside_the_jvm(spark):
    import hashlib
    import random

    from pyspark.sql import functions as F

    from siftlark.functions import hashing

    draw = random.Random(11)

    def value(depth):
        kind = draw.randint(0, 9 if depth else 6)
        if kind > 7:
            return {draw.choice(["a", "B", "aa", "_", "z9", "é"]) + str(draw.randint(0, 3)): value(depth - 1) for _ in range(draw.randint(0, 4))}
        if kind == 7:
            return [value(depth - 1) for _ in range(draw.randint(0, 3))]
        return draw.choice([0, 7, -12, 10**12, 10**17, 2**70, 1.5, -0.0, 1e30, True, False, None, "", "text", "a b/c", "tab\t", 'q"', "back\\slash", "é", "\U0001f600", "\x7f", "3.5"])

    docs = [json.dumps(value(3), ensure_ascii=draw.random() < 0.5, indent=draw.choice([None, 1])) for _ in range(400)]
    docs += ['{"a": 1, "a": 2}', "[1,2 ,3]", "0", "-0", "12345678901234567890", "1E2", '"x"', "null", "{}", "[]", None]
    found = [r[0] for r in spark.createDataFrame([(d,) for d in docs], "d string").select(hashing.canonical_hash(F.col("d"))).collect()]
    assert found == [None if d is None else hashlib.sha256(hashing.canonical_json(d).encode()).hexdigest() for d in docs]
