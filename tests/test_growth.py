"""What has to stay small when tables grow: pairs of queries and documents, memory of a scan, repeated work."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftlark.operators import fulltext, nearest, retrieval, top_terms

FIELDS = "doc_id long, title string, conditions string, interventions string, eligibility string"
TERMS = "query_id string, pos int, text string, fact_id string, kind string"


def rows_of(frame):
    return sorted(map(str, (r.asDict() for r in frame.collect())))


@pytest.mark.parametrize("limit", [1, 3, 40])
def test_best_by_fields_is_what_the_plain_join_ranks(spark, limit, monkeypatch):
    monkeypatch.setattr(top_terms, "MOST_HITS", 4)
    monkeypatch.setattr(top_terms, "MOST_TERMS", 3)
    pick = random.Random(7)
    words = ["red", "blue", "large", "large ring", "x1", "x12", "old"]
    docs = [(i, *[" ".join(pick.sample(words, pick.randint(0, 2))) for _ in range(4)]) for i in range(150)] + [(3, "red", "blue", "", "old"), (900, "red x1", "red", "large ring", "blue old x12")]
    terms = [(f"q{q}", pos, text, f"f{pick.randint(0, 3)}", "condition") for q in range(60) for pos, text in enumerate(pick.choices([*words, "none", " "], k=pick.randint(1, 5)))]
    fields, asked = spark.createDataFrame(docs, FIELDS), spark.createDataFrame(terms, TERMS)
    expected = retrieval.ranked(retrieval.score_fields(fields, asked), limit)
    found = retrieval.best_by_fields(fields, asked, limit)
    assert found.columns == expected.columns
    assert rows_of(found) == rows_of(expected)


def test_lists_of_terms_hold_no_row_for_each_query_and_document(spark, monkeypatch):
    made = {}
    keep = top_terms.stored

    def counted(frame, label):
        out = keep(frame, label)
        made[label] = out.count()
        return out

    monkeypatch.setattr(top_terms, "stored", counted)
    fields = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("a").alias("title"), F.when(F.col("id") % 2 == 0, "b").otherwise("c").alias("conditions"), F.lit("").alias("interventions"), F.lit("").alias("eligibility"))
    asked = spark.createDataFrame([(f"q{q}", p, t, "f", "condition") for q in range(300) for p, t in enumerate("ab")], TERMS)
    assert retrieval.best_by_fields(fields, asked, 5).count() == 1500
    assert made["term_classes"] == 2 and made["term_sets"] == 1


@pytest.mark.parametrize("texts", [False, True])
def test_best_rows_are_kept_in_bounded_memory(monkeypatch, texts):
    monkeypatch.setattr(nearest, "PRODUCTS", 2000)
    monkeypatch.setattr(nearest, "SPARE", 4000)
    rng = np.random.default_rng(1)
    asked, held = np.round(rng.normal(size=(30, 4))), np.round(rng.normal(size=(3000, 4)))
    ids = rng.permutation(3000).astype(np.int64)
    ids = np.array([f"d{i:05}" for i in ids], dtype=object) if texts else ids
    best, sizes = nearest.Best(30, 7), []

    def scores(mine, part, low):
        out = asked[mine] @ part.T
        sizes.append(out.size)
        return out

    for low in range(0, 3000, 500):
        best.add(np.arange(30), ids[low : low + 500], held[low : low + 500], scores)
        assert best.waiting <= 4000 and len(best.kept[0]) <= 30 * 7
    assert max(sizes) <= 2000
    found = sorted((q, d, s) for part in best.rows() for q, d, s in zip(*(x.tolist() for x in part)))
    products = asked @ held.T
    expected = sorted((q, d, s) for q in range(30) for s, d in sorted(((-s, d) for s, d in zip(products[q], ids.tolist())))[:7] for s in [-s])
    assert found == expected


def test_equal_searches_are_made_once(spark, monkeypatch):
    made = {}
    keep = fulltext.stored

    def counted(frame, label):
        out = keep(frame, label)
        made[label] = out.count()
        return out

    monkeypatch.setattr(fulltext, "stored", counted)
    documents = spark.createDataFrame([(i, "red car" if i % 4 else "red bus") for i in range(40)], "doc_id long, text string")
    asked = spark.createDataFrame([(f"q{i}", "red bus") for i in range(50)], "query_id string, text string")
    found = fulltext.search(documents, asked, 400)
    assert found.count() == 500 and found.select("query_id").distinct().count() == 50
    # Neither fifty times, nor with documents that hold only the more frequent word.
    assert made["text_candidates"] == 10


def test_missing_ids_come_back(spark):
    import pyarrow as pa

    column = pa.array([3, None, 1], pa.int64())
    assert nearest.id_column(nearest.ids_of(column), pa.int64()) == column


def test_overlap_keeps_the_best_and_makes_no_row_for_each_pair(spark, monkeypatch):
    pick = random.Random(3)
    words = [f"word{k}" for k in range(30)]
    text = lambda most: " ".join(pick.choices(words, k=pick.randint(0, most)))
    docs = [(i, text(12), text(4)) for i in range(400)] + [(3, text(12), text(4)), (None, "word1", None), (None, "word2", "word1")]
    topics = [(f"q{q}", text(8)) for q in range(40)]
    asked = spark.createDataFrame([*topics, ("none", None)], "query_id string, text string")
    weights = {"a": 2.0, "b": 0.5}
    made = []
    keep = retrieval.ranked
    monkeypatch.setattr(retrieval, "ranked", lambda frame, *rest: made.append(frame.count()) or keep(frame, *rest))
    for rows in (docs, docs[:400]):
        fields = spark.createDataFrame(rows, "doc_id long, a string, b string").coalesce(2)
        found = rows_of(retrieval.token_overlap(fields, asked, weights, 5))
        with monkeypatch.context() as plain:
            plain.setattr(retrieval, "KEPT_ROWS", 0)
            assert found == rows_of(retrieval.token_overlap(fields, asked, weights, 5))
    assert made[2] <= 40 * 5 * 2 < made[3]
