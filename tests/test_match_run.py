"""The match run as a whole: cancellation between stages, evaluation of imports, coverage at many instants."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from siftlark.operators import matching as M
from siftlark.operators import rules

NOW = dt.datetime(2024, 3, 1)
CATALOGUE = (
    "doc_id long, title string, conditions array<string>, interventions array<struct<name:string,type:string,description:string,other_names:array<string>>>, eligibility_text string, ingested_at timestamp, superseded_at timestamp"
)


def small_run(spark):
    rows = [(i, f"Study {i} of red rings", ["ring disease"], [("Brand#%d" % (i % 3), "DRUG", None, [])], "adults", NOW - dt.timedelta(9), None) for i in range(12)]
    catalogue = spark.createDataFrame(rows, CATALOGUE)
    vectors = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(12)], "doc_id long, embedding array<float>")
    embedded = catalogue.select("doc_id", "ingested_at", "superseded_at").join(vectors, "doc_id")
    runs = spark.createDataFrame([(f"r{k}", NOW, [1.0, 0.5], True, f"i{k}") for k in range(4)], "query_id string, as_of timestamp, vector array<float>, encoder_ready boolean, import_id string")
    terms = spark.createDataFrame([(f"r{k}", 0, "ring", "f", "condition") for k in range(4)], "query_id string, pos int, text string, fact_id string, kind string")
    return runs, terms, catalogue, embedded


def test_runs_stop_at_the_stage_where_they_are_cancelled(spark):
    runs, terms, catalogue, embedded = small_run(spark)
    asked = []

    def cancelled():
        """One more run is cancelled each time that the record is read: r0 before the first stage, r1 before the second and so on."""
        asked.append(None)
        return spark.createDataFrame([(f"r{k}",) for k in range(min(len(asked), 3))], "query_id string")

    candidates, stages = M.run_matches(runs, terms, catalogue, embedded, cancelled=cancelled)
    told = {r.query_id: r for r in stages.collect()}
    assert {r.query_id for r in candidates.select("query_id").distinct().collect()} == {"r3"}
    assert [told[f"r{k}"].status for k in range(4)] == ["cancelled", "cancelled", "cancelled", "completed"]
    assert told["r0"].lexical_pool == 0 and told["r0"].semantic_pool == 0
    assert told["r1"].lexical_pool == 12 and told["r1"].semantic_pool == 0 and told["r1"].fused == 0
    assert told["r2"].lexical_pool == 12 and told["r2"].semantic_pool == 12 and told["r2"].fused == 0
    assert told["r3"].persisted == 12 and told["r3"].mode == "hybrid" and len(asked) >= 5
    untouched, stages = M.run_matches(runs, terms, catalogue, embedded)
    assert untouched.count() == 48 and {r.status for r in stages.collect()} == {"completed"}


def rule(**given):
    return {"system": rules.LOINC, **given}


def test_matches_are_assessed_with_the_facts_of_their_import(spark, monkeypatch):
    matches = spark.createDataFrame([("r0", 1), ("r0", 2), ("r1", 1), ("r1", 3), ("r2", 1)], "query_id string, doc_id long")
    runs = spark.createDataFrame([("r0", "old", NOW), ("r1", "new", NOW), ("r2", "new", NOW)], "query_id string, import_id string, as_of timestamp")
    active, lab = rule(kind="medication_status", code="m", expected_status="active"), rule(kind="numeric_lab_threshold", code="2345-7", comparator=">=", threshold=5.0, unit="mmol/L")
    listed = [(1, "a", "inclusion", active, False), (1, "b", "exclusion", lab, False), (2, "c", "inclusion", active, False), (2, "d", "inclusion", active, True)]
    criteria = spark.createDataFrame(listed, f"doc_id long, criterion_id string, category string, rule {rules.RULE}, requires_human_review boolean")
    fact = lambda i, f, kind, code, value, unit, status: (i, f, kind, (rules.LOINC, code), None, value, status, unit, None, [])
    facts = [
        fact("old", "f1", "medication", "m", None, None, "active"), fact("old", "f2", "observation", "2345-7", 3.0, "mmol/L", None),
        fact("new", "f3", "medication", "m", None, None, "stopped"), fact("new", "f4", "observation", "2345-7", 9.0, "mmol/L", None),
    ]
    shape = "import_id string, fact_id string, kind string, code struct<system:string,value:string>, text string, numeric_value double, status string, unit string, effective_at timestamp, issue_codes array<string>"
    seen = []
    evaluate = rules.evaluate_criteria
    monkeypatch.setattr(rules, "evaluate_criteria", lambda c, f: seen.append(c.count()) or evaluate(c, f))
    results, outcomes = M.assess_matches(matches, runs, criteria, spark.createDataFrame(facts, shape))
    got = {(r.query_id, r.doc_id, r.criterion_id): (r.outcome, r.evidence_fact_ids, r.requires_review) for r in results.collect()}
    assert got == {
        ("r0", 1, "a"): ("met", ["f1"], False), ("r0", 1, "b"): ("met", ["f2"], False), ("r0", 2, "c"): ("met", ["f1"], False), ("r0", 2, "d"): ("met", ["f1"], True),
        ("r1", 1, "a"): ("not_met", ["f3"], False), ("r1", 1, "b"): ("not_met", ["f4"], False), ("r2", 1, "a"): ("not_met", ["f3"], False), ("r2", 1, "b"): ("not_met", ["f4"], False),
    }
    assert seen == [4]  # two imports and two rules, for eight criteria of matches
    told = {(r.query_id, r.doc_id): (r.n_results, r.match_outcome) for r in outcomes.collect()}
    assert told == {("r0", 1): (2, "potential_match"), ("r0", 2): (2, "needs_review"), ("r1", 1): (2, "likely_excluded"), ("r1", 3): (0, "needs_review"), ("r2", 1): (2, "likely_excluded")}
    stopped, none = M.assess_matches(matches, runs, criteria, spark.createDataFrame(facts, shape), lambda: spark.createDataFrame([("r0",), ("r1",)], "query_id string"))
    assert {r.query_id for r in stopped.collect()} == {r.query_id for r in none.collect()} == {"r2"}


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_coverage_at_many_instants(spark, partitions):
    draw = random.Random(3)
    at = lambda n: NOW + dt.timedelta(hours=n)
    versions = []
    for i in range(300):
        born = draw.randint(0, 50)
        versions.append((i, at(born) if i % 50 else None, at(born + draw.randint(-3, 20)) if draw.random() < 0.7 else None))
    catalogue = spark.createDataFrame(versions, "doc_id long, ingested_at timestamp, superseded_at timestamp")
    has = {i for i in range(300) if i % 3 == 0}
    embedded = spark.createDataFrame([(i,) for i in sorted(has)] * 2, "doc_id long")
    instants = spark.createDataFrame([(at(n),) for n in range(-2, 75)] * 2 + [(None,)], "as_of timestamp")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        frame = M.coverage_at(catalogue, embedded, instants)
        found = {r.as_of: (r.current, r.embedded, r.complete) for r in frame.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(found) == 77 and "NestedLoop" not in frame._jdf.queryExecution().toString()
    for n in range(-2, 75):
        live = [i for i, b, g in versions if b is not None and b <= at(n) and (g is None or g > at(n))]
        assert found[at(n)] == (len(live), len(has & set(live)), bool(live) and has >= set(live))


def test_fields_keep_the_best_of_each_batch(spark, monkeypatch):
    draw = random.Random(5)
    vectors = [(i, [draw.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)]) for i in range(200)]
    held = spark.createDataFrame(vectors, "doc_id long, embedding array<float>")
    asked = spark.createDataFrame([(f"q{i}", vectors[i][1]) for i in range(9)], "query_id string, vector array<float>")
    dot = lambda a, b, x, y: sum(p * q for p, q in zip(a[x:y], b[x:y]))
    fields, weights = {"a": (0, 2), "b": (2, 4), "c": (0, 4)}, {"a": 0.7, "b": 0.3}
    for block in (4096, 3):
        monkeypatch.setattr(M, "BLOCK", block)
        got = {(r.query_id, r.rank): r.doc_id for r in M.fielded_semantic(held, asked, fields, weights, 7).collect()}
        ranks = {(r.query_id, r.rank): (r.doc_id, round(r.score, 9)) for r in M.fielded_semantic(held, asked, fields, weights, 7, by_rank=True).collect()}
        for i in range(9):
            order = lambda x, y: sorted(range(200), key=lambda d: (-dot(vectors[i][1], vectors[d][1], x, y), d))  # noqa: B023, E731
            best = sorted(range(200), key=lambda d: (-(0.7 * dot(vectors[i][1], vectors[d][1], 0, 2) + 0.3 * dot(vectors[i][1], vectors[d][1], 2, 4)), d))[:7]
            assert [got[f"q{i}", k + 1] for k in range(7)] == best
            score = {}
            for (x, y), w in (((0, 2), 0.7), ((2, 4), 0.3)):
                for place, d in enumerate(order(x, y)[:7], 1):
                    score[d] = score.get(d, 0) + w / (60 + place)
            want = sorted(score, key=lambda d: (-round(score[d], 12), d))[:7]
            assert [ranks[f"q{i}", k + 1] for k in range(len(want))] == [(d, round(score[d], 9)) for d in want]


def test_terms_are_found_in_passes(spark, monkeypatch):
    from siftlark.operators import containment, retrieval

    draw = random.Random(8)
    texts = [(i, *["".join(draw.choices("abc ", k=9)) if draw.random() < 0.9 else None for _ in range(4)]) for i in range(80)]
    fields = spark.createDataFrame(texts, "doc_id long, conditions string, title string, interventions string, eligibility string")
    terms = sorted({"".join(draw.choices("abc", k=draw.randint(1, 4))) for _ in range(40)})
    listed = spark.createDataFrame([(f"q{i % 5}", i, t, f"f{i}") for i, t in enumerate([*terms, "", "a"])], "query_id string, pos int, text string, fact_id string")
    order = ["conditions", "title", "interventions", "eligibility"]
    first = {(d, t): next((f for f, x in zip(order, xs) if x and t in x), None) for d, *xs in texts for t in terms}
    for size in (200_000, 7):
        monkeypatch.setattr(containment, "TERMS_A_PASS", size)
        found = containment.terms_in(fields, listed.select(F.col("text").alias("term")), order).collect()
        assert len(found) == len({(r.doc_id, r.term) for r in found})
        assert {(r.doc_id, r.term): r.field for r in found} == {k: f for k, f in first.items() if f}
    scored = retrieval.score_fields(fields, listed)
    assert "NestedLoop" not in scored._jdf.queryExecution().toString()
    pool = spark.createDataFrame([(f"q{k}", d) for k in range(5) for d in range(80)], "query_id string, doc_id long")
    rows = lambda df: sorted((r.query_id, r.doc_id, r.score, r.matched_terms, r.fact_ids) for r in df.collect())
    assert rows(scored) == rows(retrieval.score_fields(fields, listed, pool))
