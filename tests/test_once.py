"""Expressions and readers that look at a value once, whatever reads their columns."""

from pyspark.sql import functions as F

from siftlark.functions import variants
from siftlark.operators import parser


def test_typed_reads_find_their_value_once(spark):
    rows = spark.createDataFrame([('{"a": " x ", "n": 2.5, "l": [1, "y"], "o": {"a": "z"}}',), ('{"a": " ", "n": "2", "l": {"b": 1}}',), ('{"a": 7, "n": true, "l": "s"}',), ('{"a": null}',)], "doc string").select(F.parse_json("doc").alias("v"))
    v = F.col("v")
    got = rows.select(variants.text(v, "$.a"), variants.number(v, "$.n"), F.size(variants.items(v, "$.l"))).collect()
    assert [tuple(r) for r in got] == [(" x ", 2.5, 2), (None, None, 0), (None, None, 0), (None, None, 0)]
    for read in (variants.text(v, "$.a"), variants.number(v, "$.a"), variants.items(v, "$.a")):
        plan = rows.select(read.alias("x"))._jdf.queryExecution().analyzed().toString()
        assert plan.count("$.a") == 1


def test_a_text_is_parsed_once(spark):
    texts = spark.createDataFrame([(1, "Inclusion Criteria:\nAge 18-60 years\nage ≥ 21 (or so)"), (2, None), (3, "age ≥ 21")], "doc_id long, eligibility_text string")
    found = parser.parse_criteria(texts)
    plan = found.where("years > 20")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "regexp" not in plan
    rows = [(r.doc_id, r.source_text, r.source_start, r.operator, r.years, r.review_reasons, str(r.parser_confidence)) for r in found.orderBy("parse_order").collect()]
    assert rows == [
        (1, "Age 18-60 years", 20, "at_least", 18, [], "1.0000"), (1, "Age 18-60 years", 20, "at_most", 60, [], "1.0000"), (1, "age ≥ 21", 36, "at_least", 21, ["nested_clause", "low_confidence_parse"], "0.6000")
    ]
