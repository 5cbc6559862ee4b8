"""Functions that no registered query runs."""

import datetime as dt
import hashlib

from pyspark.sql import functions as F

from siftlark.functions import hashing
from siftlark.functions import vectors as V
from siftlark.operators import evaluation, extract
from siftlark.sources import readers
from siftlark.streaming import queue


def test_cosine(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    found = [r[0] for r in rows.select(V.cosine(F.col("a"), F.col("b"))).collect()]
    assert abs(found[0] - 2**-0.5) < 1e-12 and found[1] is None


def test_hashes_and_bundles(spark, tmp_path):
    (tmp_path / "one.json").write_text('{"b": 1,\n "a": "é"}')
    (row,) = readers.read_bundles(spark, str(tmp_path)).collect()
    assert row.import_id == "one.json" and hashing.canonical_json(row.bundle) == '{"a":"\\u00e9","b":1}'
    study = spark.createDataFrame([(row.bundle,)], "raw_study string")
    hashed = extract.with_hashes(extract.extract_trials(study)).collect()[0]
    assert hashed.source_hash == hashlib.sha256(b'{"a":"\\u00e9","b":1}').hexdigest() and hashed.problem == "invalid_nct_id"
    keys = spark.createDataFrame([("a", None), ("a", "")], "x string, y string").select(hashing.content_hash(F.col("x"), F.col("y")).alias("h")).collect()
    assert keys[0].h != keys[1].h


def test_index_writer_resumes(spark, tmp_path):
    path = (tmp_path / "index").as_uri()
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, document string")
    encode = lambda texts: [[float(len(t))] * 2 for t in texts]
    assert readers.write_index(docs, encode, path, 2) == 2 and readers.write_index(docs, encode, path, 2) == 0
    assert {r.doc_id: r.embedding for r in spark.read.parquet(path).collect()} == {1: [1.0, 1.0], 2: [0.0, 0.0]}


def test_windowed_counts(spark):
    at = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    events = spark.createDataFrame([(at(1, 5), "a"), (at(1, 50), "a"), (at(2, 0), "b")], "ts timestamp, event_type string")
    assert sorted((r.event_type, r.n) for r in queue.windowed_counts(events).collect()) == [("a", 2), ("b", 1)]


def test_best_configuration_takes_the_first_of_equals(spark):
    rows = [(0, "w0", 0.5, 0.1), (1, "w1", 0.7, 0.2), (2, "w2", 0.7, 0.3), (3, "w3", 0.7, 0.3)]
    swept = spark.createDataFrame(rows, "ordinal int, config string, ndcg_10 double, precision_10 double")
    assert [r.config for r in evaluation.best_configuration(swept).collect()] == ["w2"]
    assert spark.range(1, 3).select(evaluation.split_of(F.col("id")).alias("s")).collect()[0].s == "tuning"


def test_patient_benchmark_rates(spark):
    outcomes = spark.createDataFrame([("likely_excluded", "likely_excluded"), ("needs_review", "potential_match"), ("potential_match", "potential_match")], "expected string, predicted string")
    evidence = spark.createDataFrame([(1,), (0,)], "n_cited int")
    (row,) = evaluation.outcome_quality(outcomes, evidence).collect()
    assert (row.exclusion_recall, row.false_clearance_rate, row.needs_review_rate, row.evidence_presence_rate) == (1.0, 1.0, 0.0, 0.5)
