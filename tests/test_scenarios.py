"""Small hand-made cases with known results, for each stage of the engine."""

import datetime as dt
import json
import zipfile

import pytest

from siftlark.functions import text as T
from siftlark.operators import fhir, metrics, parser, redaction, retrieval, review, rules, versions
from siftlark.sources import readers
from siftlark.streaming import queue

AS_OF = dt.date(2026, 8, 23)
DOCUMENT = "doc_id long, title string, conditions array<string>, interventions array<struct<name:string,type:string,description:string,other_names:array<string>>>, eligibility_text string"
TERM = "query_id string, pos int, text string, fact_id string, kind string"


def document(number, title=None, conditions=(), interventions=()):
    return (number, title, list(conditions), [(n, "DRUG", None, []) for n in interventions], None)


# --- retrieval -----------------------------------------------------------------------------------


def test_each_term_counts_once_in_its_heaviest_field(spark):
    docs = spark.createDataFrame([document(1, "Diabetes study", ["Diabetes mellitus"], ["Metformin"]), document(2, "Other")], DOCUMENT)
    terms = spark.createDataFrame([("q", 0, "Diabetes", "f1", "condition"), ("q", 1, "Metformin", "f2", "medication"), ("q", 2, " ", "f3", "condition")], TERM)
    (row,) = retrieval.score_fields(retrieval.trial_fields(docs), terms).collect()
    assert (row.doc_id, row.score, row.conditions_matches, row.title_matches, row.interventions_matches, row.eligibility_matches) == (1, 6.0, 1, 0, 1, 0)
    assert row.fact_ids == ["f1", "f2"]


def test_rank_fusion(spark):
    ranks = lambda ids: spark.createDataFrame([("q", i, r) for r, i in enumerate(ids, 1)], "query_id string, doc_id long, rank int")
    rows = retrieval.fuse_rrf(ranks([1, 2]), ranks([2, 3])).orderBy("rank").collect()
    assert [r.doc_id for r in rows] == [2, 1, 3]
    assert rows[0].score == pytest.approx(1 / 62 + 1 / 61)
    assert (rows[2].lexical_rank, rows[2].semantic_rank) == (None, 2)


def test_structured_support_comes_first_and_needs_whole_words(spark):
    docs = spark.createDataFrame([document(1, "Unrelated", ["Pancreatic cancer"]), document(2, "Study", ["Diabetes  Mellitus type 2"])], DOCUMENT)
    terms = spark.createDataFrame([("q", 0, "diabetes mellitus", "f1", "condition"), ("q", 1, "ana", "f2", "condition")], TERM)
    fused = spark.createDataFrame([("q", 1, 1), ("q", 2, 2)], "query_id string, doc_id long, rank int")
    rows = retrieval.rerank_structured(fused, docs, terms).orderBy("rank").collect()
    assert [(r.doc_id, r.tier, r.input_rank, r.rank, r.structured_status) for r in rows] == [(2, 3, 2, 1, "direct_support"), (1, 0, 1, 2, "unknown")]


def test_all_words_must_be_there(spark):
    docs = spark.createDataFrame([(1, "Red, red wine"), (2, "red"), (3, None)], "doc_id long, text string")
    asked = spark.createDataFrame([("a", "wine RED red"), ("b", " ")], "query_id string, text string")
    assert [tuple(r) for r in retrieval.and_match(docs, asked).collect()] == [("a", 1)]


def test_intervention_types_alone_reject(spark):
    from pyspark.sql import functions as F

    rows = [(1, "Recruiting", ["P1"], ["FR"], ["DRUG"]), (2, "recruiting", ["p1"], ["fr"], ["DEVICE"]), (3, "recruiting", ["p1"], ["fr"], None), (4, "recruiting", ["p1"], ["fr"], ["device", "drug"])]
    docs = spark.createDataFrame(rows, "doc_id int, status string, phases array<string>, countries array<string>, types array<string>")
    wanted = {"statuses": ["RECRUITING"], "phases": ["P1"], "countries": ["FR"]}
    columns = F.col("status"), F.col("phases"), F.col("countries")
    passed = lambda w: {r.doc_id for r in docs.where(retrieval.metadata_filter(*columns, w, F.col("types"))).collect()}
    assert passed(wanted) == {1, 2, 3, 4}
    assert passed(wanted | {"intervention_types": ["Drug"]}) == {1, 4}


def test_ranking_metrics_without_and_with_hits(spark):
    judged = spark.createDataFrame([("a", 1, 2), ("a", 2, 1), ("b", 1, 2)], "query_id string, doc_id long, grade int")
    ranked = spark.createDataFrame([("a", 9, 1), ("a", 1, 2)], "query_id string, doc_id long, rank int")
    rows = {r.query_id: r for r in metrics.ranking_metrics(ranked, judged).collect()}
    assert (rows["a"].mrr, rows["a"].precision_5, rows["a"].recall_50) == (0.5, 0.2, 1.0)
    assert (rows["b"].mrr, rows["b"].ndcg_10) == (0.0, 0.0)


# --- rules ---------------------------------------------------------------------------------------

FACT = "import_id string, fact_id string, kind string, code struct<system:string,value:string>, text string, numeric_value double, status string, unit string, effective_at timestamp, issue_codes array<string>"


def evaluate(spark, category, rule, facts):
    """(outcome, reason, evidence) of one criterion."""
    asked = spark.createDataFrame([("m", "c", "p", category, AS_OF, rule)], f"match_id string, criterion_id string, import_id string, category string, as_of date, rule {rules.RULE}")
    shaped = [("p", f"f{i}", f["kind"], (f.get("system"), f["code"]), f.get("text"), f.get("value"), f.get("status"), f.get("unit"), f.get("at"), f.get("issues", [])) for i, f in enumerate(facts)]
    (row,) = rules.evaluate_criteria(asked, spark.createDataFrame(shaped, FACT)).collect()
    assert row.requires_review == (row.outcome in ("unknown", "conflicting"))
    return row.outcome, row.reason, row.evidence_fact_ids


def test_a_birth_year_at_the_limit_is_unknown(spark):
    birth = {"kind": "demographic", "code": "birth-date", "text": "2008"}
    assert evaluate(spark, "inclusion", {"kind": "age", "operator": "at_least", "years": 18}, [birth])[:2] == ("unknown", "ambiguous_age")
    assert evaluate(spark, "inclusion", {"kind": "age", "operator": "at_least", "years": 17}, [birth])[0] == "met"


def test_a_matching_exclusion_is_not_met(spark):
    sex = {"kind": "demographic", "code": "administrative-gender", "text": "female"}
    assert evaluate(spark, "exclusion", {"kind": "recorded_sex", "value": "female"}, [sex]) == ("not_met", "predicate_matched", ["f0"])


def test_units_are_converted_for_exact_codes_only(spark):
    glucose = {"kind": "observation", "system": rules.LOINC, "code": "2345-7", "value": 144.0, "unit": "mg/dL"}
    asked = lambda t: {"kind": "numeric_lab_threshold", "system": rules.LOINC, "code": "2345-7", "comparator": ">=", "threshold": t, "unit": "mmol/L"}
    assert evaluate(spark, "inclusion", asked(8.0), [glucose])[0] == "not_met"
    assert evaluate(spark, "inclusion", asked(7.5), [glucose])[0] == "met"
    assert evaluate(spark, "inclusion", asked(7.5), [glucose | {"unit": "mg"}])[:2] == ("unknown", "unusable_evidence")


def test_facts_inside_and_outside_a_recency_window_conflict(spark):
    rule = {"kind": "recency_window", "fact_kind": "procedure", "system": "s", "code": "x", "within_days": 30}
    at = lambda *day: {"kind": "procedure", "system": "s", "code": "x", "at": dt.datetime(*day)}
    assert evaluate(spark, "inclusion", rule, [at(2026, 8, 1), at(2026, 1, 1)])[:2] == ("conflicting", "conflicting_evidence")
    assert evaluate(spark, "inclusion", rule, [at(2026, 9, 1)])[:2] == ("unknown", "future_date")


def test_without_facts_every_kind_is_unknown(spark):
    full = {
        "operator": "at_least", "years": 18, "value": "male", "system": rules.LOINC, "code": "2345-7", "comparator": ">", "threshold": 1.0, "unit": "mg/dL",
        "fact_kind": "condition", "starts_on": AS_OF, "within_days": 10, "expected_status": "active",
    }
    asked = [("m", k, "p", "inclusion", AS_OF, full | {"kind": k}) for k in rules.RULE_KINDS]
    frame = spark.createDataFrame(asked, f"match_id string, criterion_id string, import_id string, category string, as_of date, rule {rules.RULE}")
    found = rules.evaluate_criteria(frame, spark.createDataFrame([], FACT)).collect()
    assert {(r.outcome, r.reason, r.requires_review) for r in found} == {("unknown", "missing_evidence", True)} and len(found) == 8


def test_a_match_with_a_missing_result_needs_review(spark):
    matches = spark.createDataFrame([("a",), ("b",), ("c",)], "match_id string")
    wanted = spark.createDataFrame([("a", "1", "inclusion", False), ("a", "2", "exclusion", False), ("b", "1", "inclusion", False)], "match_id string, criterion_id string, category string, requires_human_review boolean")
    given = spark.createDataFrame([("a", "1", "met", False), ("a", "2", "not_met", False)], "match_id string, criterion_id string, outcome string, requires_review boolean")
    found = dict(map(tuple, rules.aggregate_matches(matches, wanted, given).collect()))
    assert found == {"a": "likely_excluded", "b": "needs_review", "c": "needs_review"}


# --- parser --------------------------------------------------------------------------------------


def test_age_criteria_give_back_their_spans(spark):
    text = "Age at least 99 years\nInclusion Criteria:\nAge at least 18 years\nage 21 to 65 years\nExclusion Criteria:\nage at most 16 years unless agreed\n"
    texts = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, eligibility_text string")
    found = parser.parse_criteria(texts)
    rows = [(r.category, r.operator, r.years, r.review_reasons) for r in found.orderBy("source_start", "operator").collect()]
    assert rows == [
        ("inclusion", "at_least", 18, []),
        ("inclusion", "at_least", 21, []),
        ("inclusion", "at_most", 65, []),
        ("exclusion", "at_most", 16, ["ambiguous_clause"]),
    ]
    assert all(text[r.source_start : r.source_end] == r.source_text for r in found.collect())
    assert parser.span_problems(found, texts).isEmpty()


# --- records and versions ------------------------------------------------------------------------

MARKER = ("urn:example:tags", "synthetic")


def bundle(patient, *resources, marked=True):
    tags = [{"system": MARKER[0], "code": MARKER[1]}] if marked else []
    return json.dumps({"resourceType": "Bundle", "meta": {"tag": tags}, "entry": [{"resource": {"resourceType": "Patient", "id": "p1"} | patient}, *({"resource": r} for r in resources)]})


def observation(number, value):
    return {
        "resourceType": "Observation", "id": f"o{number}", "status": "final", "subject": {"reference": "Patient/p1"}, "effectiveDateTime": "2026-08-01",
        "code": {"text": "Glucose", "coding": [{"system": "s", "code": "g"}]}, "valueQuantity": {"value": value, "unit": "mg/dL"},
    }


def bundles_of(spark, *rows):
    return spark.createDataFrame([(f"i{n}", b, dt.datetime(2026, 8, 23)) for n, b in enumerate(rows)], "import_id string, bundle string, evaluated_at timestamp")


def test_import_issues_come_in_order(spark):
    bundles = bundles_of(spark, bundle({}, observation(1, 11.2), observation(2, 12.4), observation(3, "high")))
    facts = fhir.normalize_bundles(bundles)
    found = [(r.code, r.field) for r in fhir.import_issues(bundles, facts).collect()]
    value = "valueQuantity.value"
    assert found == [("missing", "gender"), ("missing", "birthDate"), ("invalid", value), ("conflicting", value), ("conflicting", value)]
    assert {r.code.display for r in facts.collect()} == {"Glucose"}


def test_stale_and_impossible_dates(spark):
    link = {"subject": {"reference": "Patient/p1"}, "code": {"coding": [{"system": "s", "code": "c"}]}}
    old = {"resourceType": "Condition", "id": "c1", "onsetDateTime": "2020-01-15"} | link
    never = {"resourceType": "Procedure", "id": "x1", "performedDateTime": "2020-15-45"} | link
    facts = {r.kind: r for r in fhir.normalize_bundles(bundles_of(spark, bundle({"gender": "female"}, old, never))).collect()}
    assert [i.code for i in facts["condition"].quality_issues] == ["stale"]
    assert [i.code for i in facts["procedure"].quality_issues] == ["invalid"] and facts["procedure"].date is None
    assert facts["demographic"].text == "female"


def test_bundles_that_cannot_be_imported(spark):
    stray = observation(1, 1.0) | {"subject": {"reference": "Patient/p2"}}
    found = fhir.check_bundles(bundles_of(spark, bundle({}), bundle({}, marked=False), "{", bundle({}, stray)), MARKER)
    assert dict(map(tuple, found.collect())) == {"i0": None, "i1": "not_marked_synthetic", "i2": "invalid_json", "i3": "foreign_reference"}


def test_versions_link_reuse_and_supersede(spark):
    day = lambda d: dt.datetime(2026, 1, d)
    arrivals = [("k", "v1", "s1", "m1", day(1)), ("k", "v2", "s2", "m2", day(2)), ("k", "v3", "s3", "m2", day(3)), ("k", "v4", "s1", "m1", day(4))]
    frame = spark.createDataFrame([(*a, a[4], i) for i, a in enumerate(arrivals)], "key string, version_id string, source_hash string, matching_hash string, retrieved_at timestamp, ingested_at timestamp, seq int")
    rows = versions.build_versions(frame).orderBy("seq").collect()
    assert [(r.version_id, r.requires_reparse, r.reused_from, r.superseded_at) for r in rows] == [("v1", True, None, day(2)), ("v2", True, None, day(3)), ("v3", False, "v2", None)]


def test_the_latest_correction_counts(spark):
    results = spark.createDataFrame([(1, "m", "inclusion", "unknown"), (2, "m", "inclusion", "met")], "result_id int, match_id string, category string, outcome string")
    fixed = spark.createDataFrame([(1, 1, 5, "met"), (1, 2, 9, "not_met")], "result_id int, correction_id int, created_at int, corrected string")
    current = review.current_outcomes(results, fixed)
    assert {r.result_id: r.current_outcome for r in current.collect()} == {1: "not_met", 2: "met"}
    assert [tuple(r) for r in review.displayed_outcomes(current).collect()] == [("m", "not_relevant")]


# --- sources, queue, redaction -------------------------------------------------------------------


def test_archives_of_xml_and_judgment_files(spark, tmp_path):
    one = "<clinical_study><id_info><nct_id>NCT00000001</nct_id></id_info><brief_title>T</brief_title><condition>A</condition><condition>B</condition></clinical_study>"
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as archive:
        archive.writestr("1.xml", one)
        archive.writestr("2.xml", "<clinical_study><brief_title>none</brief_title></clinical_study>")
        archive.writestr("skip.txt", "x")
    rows = readers.parse_study_xml(readers.read_zip_members(spark, str(tmp_path / "a.zip"))).collect()
    assert [(r.doc_id, r.conditions, r.problem) for r in rows] == [("NCT00000001", ["A", "B"], None), (None, [], "missing_id")]
    (tmp_path / "q.txt").write_text("1 0 NCT1 1\n1\t0  NCT1 2\n1 0 NCT2 7\nbad line\n")
    assert [tuple(r) for r in readers.read_judgments(spark, str(tmp_path / "q.txt")).collect()] == [("1", "NCT1", 2)]


def test_appending_twice_adds_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id int, v string")
    assert [readers.append_new(rows, str(tmp_path / "t"), ["id"]) for _ in range(2)] == [2, 0]


def test_jobs_are_claimed_by_kind_and_age(spark):
    log = [(1, "match", "queued", 1), (2, "sync", "queued", 5), (3, "match", "queued", 0), (3, "match", "running", 2), (4, "sync", "queued", 3)]
    events = spark.createDataFrame(log, "job_id int, kind string, status string, at int")
    gone = spark.createDataFrame([(4,)], "job_id int")
    assert [r.job_id for r in queue.next_jobs(events, gone, 5).collect()] == [2, 1]


def test_a_drained_log_is_handed_over_once(spark, tmp_path):
    log, seen = str(tmp_path / "log"), []
    schema = "job_id int, kind string"
    for jobs in ([(1, "a"), (1, "a")], [(2, "a")]):
        frame = spark.createDataFrame(jobs, schema)
        frame.coalesce(1).write.mode("append").parquet(log)
        queue.drain(spark, log, frame.schema, str(tmp_path / "checkpoint"), lambda batch, number: seen.extend(r.job_id for r in batch.collect()))
    assert seen == [1, 2]


def test_redaction_of_text_and_nested_json(spark):
    texts = ["write to a.b@c.org or 555-1234", "ssn 123-45-6789", '{"resourceType": "Patient"}', None]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in frame.select(T.redact(frame.text)).collect()] == ["write to [REDACTED] or [REDACTED]", "ssn [REDACTED]", T.REDACTED_CONTENT, None]
    body = json.dumps({"patient_name": "x", "n": 1, "list": ["call 555-1234"]})
    (row,) = spark.createDataFrame([(body,)], "body string").select(redaction.redact_json("body")).collect()
    assert json.loads(row[0]) == {"patient_name": "[REDACTED]", "n": 1, "list": ["call [REDACTED]"]}
