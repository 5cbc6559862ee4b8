"""Web search language, positional index and cover density against brute force."""

import json
import random

import pytest
from pyspark.sql import functions as F

from siftlark.operators import fulltext as X
from siftlark.operators.fulltext import Item


def item(*words, no=False):
    return Item(no, words)


@pytest.mark.parametrize(
    "text, sides",
    [
        ("red  Ring", [[item("red"), item("ring")]]),
        ('"red ring" small', [[item("red", "ring"), item("small")]]),
        ("red or blue ring", [[item("red")], [item("blue"), item("ring")]]),
        ("red OR -blue", [[item("red")]]),
        ("-blue", []),
        ("red -blue -\"old ring\"", [[item("red"), item("blue", no=True), item("old", "ring", no=True)]]),
        ("brand#17", [[item("brand", "17")]]),
        ("or red", [[item("or"), item("red")]]),
        ("red or", [[item("red"), item("or")]]),
        ("red or or blue", [[item("red")], [item("or"), item("blue")]]),
        ('red "or" blue', [[item("red"), item("or"), item("blue")]]),
        ('"open end', [[item("open", "end")]]),
        ("red red", [[item("red")]]),
        ("Straße", [[item("strasse")]]),
        ("", []), (None, []), (' - "" !', []),
    ],
)
def test_language(text, sides):
    assert X.parse(text) == sides


def brute(sides, strings):
    """Rank by all stretches of the document; every side is tried on all of them."""
    words, at = {}, 0
    for text in strings or ():
        if text is None:
            continue
        for w in X.words_of(text):
            words[at] = w
            at += 1
        at += X.STRING_GAP
    holds = lambda it, a, b: any(all(words.get(p + k) == w for k, w in enumerate(it.words)) for p in range(a, b - len(it.words) + 2))
    fitting = [s for s in sides if all(holds(i, 0, at) != i.excluded for i in s)]
    met = [(a, b) for a in range(at) for b in range(a, at) if any(all(holds(i, a, b) for i in s if not i.excluded) for s in fitting)]
    if not met:
        return None
    least = [s for s in met if not any(t != s and s[0] <= t[0] and t[1] <= s[1] for t in met)]
    told = {w for s in fitting for i in s if not i.excluded for w in i.words}
    return round(sum(0.1 / (1 + (b - a) - (sum(words.get(p) in told for p in range(a, b + 1)) - 1)) for a, b in least), 9)


def random_texts(seed, n, letters="abcde"):
    draw = random.Random(seed)
    return [(i, [" ".join(draw.choices(letters, k=draw.randint(0, 12))) for _ in range(draw.randint(0, 3))]) for i in range(n)]


def random_queries(seed, n, letters="abcdef"):
    draw = random.Random(seed)

    def chunk():
        words = draw.choices(letters, k=draw.choice([1, 1, 1, 2, 3]))
        return draw.choice(["", "", "", "-"]) + ('"' + " ".join(words) + '"' if len(words) > 1 or draw.random() < 0.2 else words[0])

    return [(f"q{i}", " ".join(draw.choice(["", "", "or "]) + chunk() for _ in range(draw.randint(1, 4)))) for i in range(n)]


def expected(docs, queries):
    found = {(q, d): brute(X.parse(t), s) for q, t in queries for d, s in docs}
    return {k: r for k, r in found.items() if r is not None}


def test_search_and_index_match_brute_force(spark, tmp_path, monkeypatch):
    docs, queries = random_texts(1, 150), random_queries(2, 60) + [("none", None), ("blank", "  ")]
    documents = spark.createDataFrame(docs, "doc_id long, strings array<string>")
    asked = spark.createDataFrame(queries, "query_id string, text string")
    wanted = expected(docs, queries)
    read = lambda df: {(r.query_id, r.doc_id): r.cover_rank for r in df.collect()}
    assert len(wanted) > 500 and read(X.search(documents, asked)) == wanted
    index = X.TextIndex(spark, (tmp_path / "index").as_uri(), buckets=5)
    monkeypatch.setattr(X, "DOCS_A_FILE", 40)
    index.append(documents.where("doc_id < 90"))
    index.append(documents.where("doc_id >= 90"))
    assert read(index.search(asked)) == wanted
    # The joins that larger queries take, and documents read without being told the words.
    monkeypatch.setattr(X, "FILTER_WORDS", 0)
    monkeypatch.setattr(X, "TOLD_WORDS", 0)
    monkeypatch.setattr(X.retrieval, "BROADCAST_ROWS", 0)
    assert read(index.search(asked)) == wanted and read(X.search(documents, asked)) == wanted
    best = X.search(documents, asked, 3).collect()
    for q, _ in queries:
        order = sorted(((-r, d) for (k, d), r in wanted.items() if k == q))[:3]
        assert [(r.doc_id, r.rank) for r in sorted((b for b in best if b.query_id == q), key=lambda b: b.rank)] == [(d, i + 1) for i, (_, d) in enumerate(order)]


def test_a_batch_without_its_words_is_not_read(spark, tmp_path):
    import shutil

    index = X.TextIndex(spark, (tmp_path / "index").as_uri())
    rows = lambda *r: spark.createDataFrame(r, "doc_id long, text string")
    index.append(rows((1, "red ring")))
    before = set((tmp_path / "index" / "words").iterdir())
    index.append(rows((2, "red ring")))
    for new in set((tmp_path / "index" / "words").iterdir()) - before:
        shutil.rmtree(new) if new.is_dir() else new.unlink()
    asked = spark.createDataFrame([("q", "ring")], "query_id string, text string")
    assert [r.doc_id for r in index.search(asked).collect()] == [1]


def test_only_the_words_files_are_read(spark, tmp_path):
    index = X.TextIndex(spark, (tmp_path / "index").as_uri(), buckets=16)
    index.append(spark.createDataFrame([(i, f"w{i % 40} x{i}") for i in range(400)], "doc_id long, text string"))
    held, _ = index.read()
    bucket = spark.range(1).select(X.bucket_of(F.lit("w7"), 16).alias("b")).first().b
    files = {r.f for r in held.where(F.col("bucket") == bucket).select(F.col("_metadata.file_path").alias("f")).collect()}
    assert files and all(f"bucket={bucket}/" in f for f in files)
    assert index.search(spark.createDataFrame([("q", "w7")], "query_id string, text string")).count() == 10


def test_instants(spark):
    at = lambda d: f"2024-01-{d:02d} 00:00:00"
    docs = spark.createDataFrame([(1, "ring", at(1), at(5)), (2, "ring", at(5), None), (3, "ring", None, None)], "doc_id long, text string, ingested_at string, superseded_at string")
    docs = docs.selectExpr("doc_id", "text", "cast(ingested_at AS timestamp) AS ingested_at", "cast(superseded_at AS timestamp) AS superseded_at")
    asked = spark.createDataFrame([("a", "ring", at(4)), ("b", "ring", at(5)), ("c", "ring", None)], "query_id string, text string, as_of string").withColumn("as_of", F.col("as_of").cast("timestamp"))
    found = {(r.query_id, r.doc_id) for r in X.search(docs, asked).collect()}
    assert found == {("a", 1), ("b", 2), ("c", 1), ("c", 2), ("c", 3)}


def test_strings_of_a_record(spark):
    record = {"title": "A b", "id": {"zz": 1, "b": "first", "aa": ["x", {"k": "y"}, None, True]}, "é": "last?"}
    assert X.record_strings(json.dumps(record)) == ["first", "x", "y", "last?", "A b"]
    assert X.record_strings("{broken") == [] and X.record_strings(None) == []
    rows = spark.createDataFrame([(json.dumps(record),)], "raw string")
    assert rows.select(X.strings_of(F.col("raw")).alias("s")).first().s == ["first", "x", "y", "last?", "A b"]
    # Words of two strings are never one phrase.
    assert X.cover_density(X.parse('"x y"'), {"x": [1], "y": [3]}) is None


def test_odd_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "ring"), (3, "ring"), (3, "ring")], "doc_id long, text string")
    asked = spark.createDataFrame([("q", "ring")], "query_id string, text string")
    assert {r.doc_id for r in X.search(docs, asked).collect()} <= {None, 3}
    assert X.search(docs.limit(0), asked).collect() == [] and X.search(docs, asked.limit(0)).collect() == []


def test_few_and_many_queries_find_the_same(spark, monkeypatch):
    """Searches told to every task and those joined by words agree, as of an instant too."""
    from datetime import datetime as at

    texts = ["a b c", "a c", "b a d", "c d", "a b", "d a b c a"]
    docs = spark.createDataFrame([(i, t, at(2020, 1, 1 + i), at(2020, 2, 1) if i % 2 else None) for i, t in enumerate(texts)], "doc_id long, text string, ingested_at timestamp, superseded_at timestamp")
    asked = ['"a b" c', "a -d", "b or c d", "a b", "x or a", "x a", "-a b", '"c a"', "", "a b"]
    rows = [(q, text, day) for q, text in enumerate(asked) for day in (at(2020, 1, 4), at(2020, 3, 1))] + [(99, "a b", None)]
    queries = spark.createDataFrame([(f"{q}-{day}", text, day) for q, text, day in rows], "query_id string, text string, as_of timestamp")
    found = {}
    for told in (X.TOLD_SIDES, 0):
        monkeypatch.setattr(X, "TOLD_SIDES", told)
        found[told] = sorted((r.query_id, r.doc_id, r.cover_rank) for r in X.search(docs, queries).collect())
    few, many = found.values()
    assert few == many and len(few) > 20
