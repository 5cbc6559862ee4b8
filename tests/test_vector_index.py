"""Inverted file over k-means cells against the exact search."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from siftlark.operators import matching
from siftlark.operators import vector_index as V

BORN = dt.datetime(2024, 1, 1)
VECTORS = "doc_id long, embedding array<float>, ingested_at timestamp, superseded_at timestamp"
QUERIES = "query_id string, vector array<float>, as_of timestamp"


def clustered(seed, n, groups=20, width=12, spread=0.05):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(groups, width))
    return [(i, [float(x) for x in centres[i % groups] + spread * draw.normal(size=width)], BORN, None) for i in range(n)]


def test_clustered_vectors_need_a_small_share(spark):
    rows = clustered(1, 2000)
    vectors = spark.createDataFrame(rows, VECTORS)
    asked = spark.createDataFrame([(f"q{i}", rows[i][1], BORN) for i in range(0, 2000, 50)], QUERIES)
    index = V.VectorIndex.build(vectors, cells=40)
    assert index.sizes.sum() == 2000 and index.share_for(20) < 0.2
    exact = matching.semantic_candidates(vectors, asked, 20)
    found = index.search(asked, 20)
    told = V.recall(found, exact).collect()
    assert len(told) == 40 and sum(r.n_found for r in told) >= 0.9 * sum(r.n_exact for r in told)
    scores = {(r.query_id, r.doc_id): r.score for r in exact.collect()}
    assert all(abs(scores[k] - r.score) < 1e-9 for r in found.collect() if (k := (r.query_id, r.doc_id)) in scores)


def test_all_cells_are_the_exact_search(spark, monkeypatch):
    rows = clustered(2, 300) + [(500 + i, clustered(2, 1)[0][1], BORN, None) for i in range(150)]  # a third are copies
    rows += [(900, None, BORN, None), (901, [0.0] * 12, BORN, None), (902, [1.0] * 3, BORN, None), (903, [float("nan")] * 12, BORN, None), (904, rows[5][1], BORN, BORN + dt.timedelta(1)), (905, rows[5][1], None, None)]
    vectors = spark.createDataFrame(rows, VECTORS)
    asked = spark.createDataFrame([(f"q{i}", rows[i][1], BORN + dt.timedelta(i % 3)) for i in range(12)] + [("none", None, BORN), ("zero", [0.0] * 12, BORN), ("short", [1.0], BORN)], QUERIES)
    monkeypatch.setattr(V, "VECTORS_A_FILE", 40)
    monkeypatch.setattr(V, "BLOCK", 5)
    read = lambda df: sorted((r.query_id, r.rank, r.doc_id, r.score) for r in df.collect())
    assert read(V.VectorIndex.build(vectors).search(asked, 30, share=1.0)) == read(matching.semantic_candidates(vectors, asked, 30))


def test_only_visited_folders_are_read(spark):
    vectors = spark.createDataFrame(clustered(3, 400, groups=8), VECTORS)
    index = V.VectorIndex.build(vectors, cells=8)
    visited = index.probes(V.unit(np.array([clustered(3, 1, groups=8)[0][1]])), 0.05)[0].tolist()
    files = {r.f for r in spark.read.parquet(index.path).where(F.col("cell").isin(visited)).select(F.col("_metadata.file_path").alias("f")).collect()}
    assert len(visited) < 8 and files and all(any(f"cell={c}/" in f for c in visited) for f in files)


def test_no_vectors(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert V.VectorIndex.build(empty).search(spark.createDataFrame([("q", [1.0], BORN)], QUERIES)).collect() == []
    few = spark.createDataFrame(clustered(4, 3), VECTORS)
    assert V.VectorIndex.build(few).search(spark.createDataFrame([("q", clustered(4, 1)[0][1], BORN)], QUERIES), 10).count() == 3
