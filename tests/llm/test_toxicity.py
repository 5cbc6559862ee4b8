import random
import zlib

from siftlark.llm import toxicity
from tests.llm.conftest import words


def corpus(n):
    draw, docs, labels = random.Random(9), [], []
    for i in range(n):
        text = words(i, draw.randint(20, 200))
        toxic = draw.random() < 0.15
        if toxic:
            for _ in range(draw.randint(2, 5)):
                text.insert(draw.randrange(len(text)), draw.choice(["nastyword", "badword", "vileword"]))
        docs.append((i, " ".join(text), "en", "s"))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark, make_docs):
    docs, labels = corpus(900)
    truth = {i: t for i, _, t in labels}
    rows = toxicity.toxicity(make_docs(docs, clashing=True), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    tested = [r for r in rows if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in tested) / len(tested) > 0.97


def test_labels_of_held_out_rows_are_never_learned(spark, make_docs):
    docs, labels = corpus(200)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels]
    schema = "doc_id long, quality int, toxic int"
    a, b = (toxicity.fit(make_docs(docs), spark.createDataFrame(x, schema)) for x in (labels, flipped))
    assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()


def test_odd_rows_and_no_labels(spark, make_docs, odd_rows):
    labels = spark.createDataFrame([(1, 1, None), (None, 1, 1), (10**9, 0, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity(make_docs(odd_rows, clashing=True), labels).collect()
    assert len(rows) == len(odd_rows) and len({r.score for r in rows}) == 1
    docs = make_docs(odd_rows, clashing=True)
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns
    assert toxicity.toxicity(make_docs([]), labels).count() == 0


def test_rare_terms_are_learned_at_the_row_bound(spark):
    """A term in two labelled documents keeps its weight at 20,000 rows."""
    from pyspark.sql import functions as F

    n = toxicity.MOST_ROWS
    ids = spark.range(2 * n).where(~toxicity.held_out(F.col("id"))).limit(n).select(F.col("id").alias("doc_id")).persist()
    rare = [r.doc_id for r in ids.orderBy("doc_id").limit(2).collect()]
    is_rare = F.col("doc_id").isin(rare)
    docs = ids.select("doc_id", F.concat(F.lit("plain talk "), F.col("doc_id") % 50, F.when(is_rare, " slurword").otherwise("")).alias("text"))
    labels = ids.select("doc_id", is_rare.cast("int").alias("toxic"))
    at, weights = toxicity.fit(docs, labels)
    found = toxicity.score(spark.createDataFrame([(1, "slurword"), (2, "plain talk 7")], "doc_id long, text string"), (at, weights)).collect()
    score = {r.doc_id: r.score for r in found}
    assert score[1] > 10 * score[2] and len(at) > 1
