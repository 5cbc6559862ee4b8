"""Toxicity scores by FTRL-proximal logistic regression over hashed words, word pairs and skip pairs.

Learning takes at most ``most_rows`` labelled documents with at most ``most_features`` features in all
(documented bounds; those with the smallest hash of their id, so the choice is the same in every run).
Their features are extracted in parallel; one task then passes over them ``epochs`` times, as often on
small tables as on large ones. L1 leaves some hundreds of weights of ``2 ** bits``, which is what
scoring carries to every executor.

Scoring reads every whole text. Labels, language, source and id are no features.

Defined results
- A null or empty text has no features: its score is the bias alone.
- Null labels and labels without a document teach nothing; of several labels of one id the largest
  counts. With no labelled row, or labels of one kind only, the score is the smoothed share.
- A null ``doc_id`` comes back as null and is not held out. Repeated rows are each scored; if rows of
  one labelled id differ, the first text in string order is learned from, once.
- A score of exactly ``LEAST_SCORE`` counts as toxic: it is predicted 1 and ``drop_toxic`` drops it.
- An empty table gives an empty result. Columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlark.llm.common import materialize, quoted, text_of
from siftlark.llm.ftrl import Features, Ftrl, sigmoid

BITS = 20
MOST_ROWS = 20_000
#: Features of all learned documents together, four bytes each: what the learning task holds.
MOST_FEATURES = 100_000_000
EPOCHS = 10
LEAST_SCORE = 0.3
BATCH = 200


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _scan(bits: int, columns: list[str], finish):
    """A function for ``mapInArrow`` that hands rows and their features to ``finish`` by small batches."""

    def scan(batches):
        features = Features(bits)
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                part = batch.slice(start, BATCH)
                yield finish([part.column(c) for c in columns], [features(t) for t in part.column("text").to_pylist()])

    return scan


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, bits: int = BITS, epochs: int = EPOCHS, most_features: int = MOST_FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and weights that are not zero; the last one is the bias."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("toxic").isNotNull() & F.col("label_id").isNotNull() & ~held_out(F.col("label_id")))
        .groupBy("label_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("label_id"), "label_id")
        .limit(most_rows)
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("label_id"), text_of().alias("text"))
    met = rows.join(F.broadcast(chosen), "label_id")  # most_rows bounds the broadcast
    learned = met.groupBy("label_id", "toxic").agg(F.min("text").alias("text"))

    def pack(columns, found):
        return pa.RecordBatch.from_arrays(
            [columns[0].cast(pa.int64()), columns[1].cast(pa.int32()), pa.array([f.astype("<u4").tobytes() for f in found], pa.binary())], ["label_id", "toxic", "features"]
        )

    extracted = learned.select("label_id", "toxic", "text").mapInArrow(_scan(bits, ["label_id", "toxic"], pack), "label_id long, toxic int, features binary")

    def learn(batches):
        found, labels, held = [], [], 0
        for batch in batches:
            for features, toxic in zip(batch.column("features"), batch.column("toxic").to_pylist()):
                if held > most_features:
                    break
                found.append(np.frombuffer(features.as_py(), dtype="<u4"))
                labels.append(toxic)
                held += len(found[-1])
        model = Ftrl(bits)
        model.start_from((sum(labels) + 1) / (len(labels) + 2))
        if labels:
            order = np.random.default_rng(0)
            for _ in range(epochs):
                for row in order.permutation(len(labels)):
                    model.learn(found[row], labels[row])
        at, weights = model.nonzero()
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(weights, pa.float64())], ["at", "weight"])

    # A set order of rows, so that the same rows give the same model; the bound makes one task enough.
    ordered = materialize(extracted, "toxicity_rows").repartition(1).sortWithinPartitions(F.xxhash64("label_id"), "label_id", "features")
    rows = ordered.mapInArrow(learn, "at long, weight double").collect()
    if not rows:  # an empty partition is not run
        return np.array([1 << bits]), np.array([0.0])
    return np.array([r.at for r in rows]), np.array([r.weight for r in rows])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], bits: int = BITS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of every row and its score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    dense: dict[str, np.ndarray] = {}

    def finish(columns, found):
        if not dense:
            at, weights = sent.value
            dense["w"] = np.zeros((1 << bits) + 1)
            dense["w"][at] = weights
        w = dense["w"]
        scores = [sigmoid(w[f].sum() + w[-1]) for f in found]
        return pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.float64())], [*keep, "score"])

    read = docs.select(*keep, text_of().alias("text"))
    schema = read.select(*keep, F.lit(0.0).alias("score")).schema
    return read.mapInArrow(_scan(bits, list(keep), finish), schema)


def toxicity(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return score(ids, fit(docs, labels, most_rows)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= LEAST_SCORE).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """The rows of ``docs`` whose score stays below the threshold, with all their columns."""
    model = fit(docs, labels, most_rows)
    nested = docs.select(F.struct(*quoted(docs)).alias("row"), "text")
    return score(nested, model, keep=("row",)).where(F.col("score") < LEAST_SCORE).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
