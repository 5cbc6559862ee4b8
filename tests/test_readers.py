"""Readers, writers and the frozen retrieval demonstration."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from siftlark.operators import metrics, retrieval
from siftlark.sources import loading, readers

# Nine studies, two topics and their judgments of the frozen demonstration.
STUDIES = [
    (1, "Metformin treatment study", "Diabetes mellitus", "Metformin", "Adults with diabetes mellitus."),
    (2, "Diabetes and metformin outcomes study", "Type 2 diabetes", "Metformin", "Adults with diabetes."),
    (3, "Diabetes study with a documented exclusion", "Diabetes mellitus", None, "Diabetes is required; a separate exclusion applies."),
    (4, "Asthma control study", "Asthma", None, "Asthma control."),
    (5, "Health records archive", "General health", None, "The word diabetes is mentioned for background only."),
    (6, "Melanoma pathway study", "Melanoma", None, "Melanoma cohort."),
    (7, "Melanoma study with an exclusion criterion", "Melanoma", None, "An exclusion applies to this melanoma study."),
    (8, "Melanoma education registry", "General health", None, "Educational material mentioning melanoma."),
    (9, "Lung cancer study", "Lung cancer", None, "Lung cancer cohort."),
]
TOPICS = [("d", 0, "Diabetes", "f1", "condition"), ("d", 1, "Metformin", "f2", "medication"), ("m", 0, "Melanoma", "f3", "condition")]
GRADES = [("d", 1, 2), ("d", 2, 2), ("d", 3, 1), ("d", 4, 0), ("d", 5, 0), ("m", 6, 2), ("m", 7, 1), ("m", 8, 0), ("m", 9, 2)]


def test_frozen_demonstration_gives_the_published_numbers(spark):
    kind = "doc_id long, title string, conditions array<string>, interventions array<struct<name:string,type:string,description:string,other_names:array<string>>>, eligibility_text string"
    studies = spark.createDataFrame([(i, t, [c], [(n, "DRUG", None, [])] if n else [], e) for i, t, c, n, e in STUDIES], kind)
    terms = spark.createDataFrame(TOPICS, "query_id string, pos int, text string, fact_id string, kind string")
    ranked = retrieval.ranked(retrieval.score_fields(retrieval.trial_fields(studies), terms), 100)
    judged = spark.createDataFrame(GRADES, "query_id string, doc_id long, grade int")
    (mean,) = metrics.mean_metrics(metrics.ranking_metrics(ranked, judged)).collect()
    expected = {"ndcg_5": 0.836647, "ndcg_10": 0.836647, "precision_5": 0.3, "precision_10": 0.15, "recall_50": 0.75, "mrr": 1.0, "grade_1_rate_10": 0.291667}
    assert {k: round(mean[k], 6) for k in expected} == expected


def test_loading_only_what_is_new_and_in_order(spark, tmp_path):
    path = (tmp_path / "t").as_uri()
    rows = lambda ids: spark.createDataFrame([(i, f"v{i}") for i in ids], "id long, v string")
    assert readers.append_new(rows([1, 2, 2]), path, ["id"]) == 2
    assert readers.append_new(rows([1, 2]), path, ["id"]) == 0
    assert readers.append_new(rows([3]), path, ["id"], "id") == 1
    with pytest.raises(ValueError):
        readers.append_new(rows([0]), path, ["id"], "id")
    with pytest.raises(ValueError):
        readers.load_empty(rows([9]), path)
    assert readers.load_empty(rows([9]), (tmp_path / "new").as_uri()) == 1
    assert spark.read.parquet(path).count() == 3


def test_vectors_datasets_reports_and_demo_jobs(spark, tmp_path):
    for name in ("title", "body"):
        (tmp_path / f"{name}.f32").write_bytes(b"".join(struct.pack("<3f", i, i + 1, i + 2) for i in range(5)))
    found = readers.read_vectors(spark, str(tmp_path), 3, ("title", "body")).orderBy("field", "row_no").collect()
    assert [(r.field, r.row_no, r.embedding) for r in found][:2] == [("body", 0, [0.0, 1.0, 2.0]), ("body", 1, [1.0, 2.0, 3.0])] and len(found) == 10
    (tmp_path / "good.json").write_text('{"configuration": {"a": "b"}, "cases": [1, 2]}')
    (row,) = readers.read_dataset(spark, str(tmp_path / "good.json"), "cases array<int>").collect()
    assert row.cases == [1, 2]
    (tmp_path / "bad.json").write_text("[1]")
    with pytest.raises(ValueError):
        readers.read_dataset(spark, str(tmp_path / "bad.json"), "cases array<int>")
    readers.write_report(spark.createDataFrame([(1, None)], "b int, a string"), str(tmp_path / "report"))
    (part,) = (tmp_path / "report").glob("part-*")
    assert part.read_text().strip() == '{"a":null,"b":1}'
    jobs = readers.demo_jobs(spark, "2026-01-01").collect()
    assert len(jobs) == 3 and {j.status for j in jobs} == {"queued"}


def test_marking_single_patient_bundles(spark):
    one = json.dumps({"resourceType": "Bundle", "entry": [{"resource": {"resourceType": "Patient", "id": "a"}}], "meta": {"tag": [{"system": "x", "code": "y"}]}})
    two = json.dumps({"resourceType": "Bundle", "entry": [{"resource": {"resourceType": "Patient"}}] * 2})
    rows = readers.marked_bundles(spark.createDataFrame([("a", one), ("b", two), ("c", "no json")], "import_id string, bundle string"), ("s", "c")).collect()
    assert [r.import_id for r in rows] == ["a"]
    made = json.loads(rows[0].bundle)
    assert made["meta"]["tag"] == [{"system": "x", "code": "y"}, {"system": "s", "code": "c"}] and made["entry"][0]["resource"]["id"] == "a"


def test_marking_keeps_all_else_of_a_bundle(spark):
    patient = {"entry": [{"resource": {"resourceType": "Patient", "id": "a", "n": [1.5, None]}}], "resourceType": "Bundle"}
    metas = {"none": None, "empty": {}, "full": {"versionId": "7", "profile": ["p"], "tag": [{"system": "x", "code": "y", "userSelected": True}]}, "has": {"tag": [{"code": "c", "system": "s"}]}, "text": "no", "map": {"tag": {}}}
    rows = [(k, json.dumps(patient if m is None else patient | {"meta": m})) for k, m in metas.items()]
    found = {r.import_id: json.loads(r.bundle) for r in readers.marked_bundles(spark.createDataFrame(rows, "import_id string, bundle string"), ("s", "c")).collect()}
    assert set(found) == {"none", "empty", "full", "has"}
    tag = {"system": "s", "code": "c"}
    assert found["none"] == found["empty"] == patient | {"meta": {"tag": [tag]}}
    assert found["full"] == patient | {"meta": {"versionId": "7", "profile": ["p"], "tag": [*metas["full"]["tag"], tag]}}
    assert found["has"] == patient | {"meta": metas["has"]}


def test_loads_out_of_order_are_refused_as_a_whole(spark, tmp_path):
    path = (tmp_path / "t").as_uri()
    frame = lambda ids, parts=3: spark.createDataFrame(spark.sparkContext.parallelize([(i, f"v{i}") for i in ids], parts), "id string, v string")
    names = [f"N{i:03d}" for i in range(40)]
    bad = {"inside": names[:5] + names[6:7] + names[5:6] + names[7:], "across": names[20:] + names[:20], "twice": names[:10] + names[9:], "null": names[:3] + [None] + names[3:]}
    for ids in bad.values():
        with pytest.raises(ValueError, match="does not follow"):
            loading.load_in_order(frame(ids, 2), path, "id")
        assert not (tmp_path / "t").exists()
    assert loading.load_in_order(frame(names[:20]), path, "id") == 20
    with pytest.raises(ValueError, match="must follow N019"):
        loading.load_in_order(frame(names[19:]), path, "id")
    assert loading.load_in_order(frame(names[20:], 7), path, "id") == 20 and loading.load_in_order(frame([]), path, "id") == 0
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == names
    index = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "row_no long, id string")
    assert loading.index_mismatches(frame(names, 5), index, "id").count() == 0
    swapped = names[:7] + [names[8], names[7]] + names[9:]
    assert {(r.row_no, r.found, r.expected) for r in loading.index_mismatches(frame(swapped, 4), index, "id").collect()} == {(7, "N008", "N007"), (8, "N007", "N008")}
    assert {(r.row_no, r.expected) for r in loading.index_mismatches(frame(names[:-1], 4), index, "id").collect()} == {(39, "N039")}


def test_appending_returns_the_new_keys(spark, tmp_path):
    path = (tmp_path / "t").as_uri()
    rows = lambda *ids: spark.createDataFrame([(i, f"v{i}") for i in ids], "id long, v string")
    assert [sorted(r.id for r in loading.append_returning(rows(*ids), path, ["id"]).collect()) for ids in ((1, 2, 2), (2, 3), (3,))] == [[1, 2], [3], []]
    assert spark.read.parquet(path).count() == 3


def test_vectors_are_read_by_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "VECTORS_A_TASK", 4)
    (tmp_path / "title.f32").write_bytes(b"".join(struct.pack("<2f", i, -i) for i in range(11)))
    (tmp_path / "none.f32").write_bytes(b"")
    found = sorted((r.field, r.row_no, r.embedding) for r in readers.read_vectors(spark, str(tmp_path), 2, ("title", "none")).collect())
    assert found == [("title", i, [float(i), float(-i)]) for i in range(11)]
    (tmp_path / "torn.f32").write_bytes(b"12345")
    with pytest.raises(Exception, match="not a whole number of vectors"):
        readers.read_vectors(spark, str(tmp_path), 2, ("torn",)).collect()


def test_split_covers_all_topics(spark):
    from siftlark.operators import evaluation

    topics = lambda ids: spark.createDataFrame([(i,) for i in ids], "topic int")
    assert evaluation.split_problems(topics(range(1, 51)), topics(range(1, 51)), topics(range(1, 60))).collect() == []
    found = evaluation.split_problems(topics([*range(2, 51), 77]), topics(range(1, 50))).collect()
    assert sorted(map(tuple, found)) == [(1, "missing"), (50, "not_in_ranking_1"), (77, "beside_protocol"), (77, "not_in_ranking_1")]


def test_topics_and_study_pages(spark, tmp_path):
    (tmp_path / "topics.xml").write_text("<topics><topic number='1'>A  man\nof 50</topic><topic number='2'>B</topic></topics>")
    assert sorted(map(tuple, readers.read_topics(spark, str(tmp_path / "topics.xml")).collect())) == [("1", "A man of 50"), ("2", "B")]
    pages = tmp_path / "pages"
    pages.mkdir()
    (pages / "page-1.json").write_text('{"studies": [{"a": 1}, {"a": 2}]}')
    (pages / "page-2.json").write_text('{"studies": 3}')
    (pages / "page-3.json").write_text('{"studies": [{"a": 3}]}')
    rows = readers.read_study_pages(spark, str(pages), 1, 2).collect()
    assert sorted((r.page_no, r.problem, r.raw_study) for r in rows if r.problem is None) == [(1, None, '{"a":1}'), (1, None, '{"a":2}')]
    assert [r.page_no for r in rows if r.problem] == [2]
    assert readers.page_range_problem(None, None, 1, 11) and readers.page_range_problem("NCT00000001", "x", None, None) and not readers.page_range_problem(None, "x", None, None)


def test_checksums(spark, tmp_path):
    import hashlib

    (tmp_path / "a").write_text("1")
    (tmp_path / "b").write_text("2")
    manifest = spark.createDataFrame([("a", hashlib.sha256(b"1").hexdigest()), ("b", "0"), ("c", "0")], "name string, sha256 string")
    assert sorted(map(tuple, readers.checksum_problems(spark, str(tmp_path), manifest).collect())) == [("b", "changed"), ("c", "missing")]


def test_redacted_reasons_and_filter_values(spark):
    from siftlark.functions import text as T
    from siftlark.operators import review

    rows = spark.createDataFrame([("evidence_stale", [" b  c", "", "a", "a"]), ("John said", [])], "reason string, v array<string>")
    found = rows.select(review.redacted_reason("reason").alias("r"), T.filter_values(F.col("v")).alias("f"), T.distinct_join(F.col("v")).alias("j")).collect()
    assert [(r.r, r.f) for r in found] == [("evidence_stale", ["a", "b c"]), ("legacy_reason_redacted", [])]
    assert found[0].j == " b  c  a"
