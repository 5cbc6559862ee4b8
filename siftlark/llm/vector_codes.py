"""Vector codes by codebooks of vector parts, each nearest entry found through a VA-file.

Components become integers, ``floor(SCALE * x)``, and a vector is cut into equal consecutive parts. Each part
position has a codebook, which starts as the parts of the smallest ids and moves for some rounds to the
componentwise ``floor`` of the mean of its parts. A code is the list of the nearest entries.

The entries of a codebook are kept as a VA-file: in every coordinate they are quantised into ``2 ** bits`` cells of about
equal population. For a batch of parts, lookup tables hold the least and the greatest squared distance from each
part's coordinate to each cell; their sums over coordinates bound its distance to every entry. Entries whose lower
bound does not pass the least upper bound overlap, and only for those is the distance itself computed, in integers; ties go to the lower index.

Codebooks have ``entries`` times dimension integers, whatever the number of vectors: that proven size is broadcast, and
each round's sums come down to one row per entry and task before the shuffle, and to one per entry on the driver.

Defined results
- Rows whose vector is null or holds a null, an infinity or no number are dropped. The dimension is the most common length that the
  number of parts divides (ties: the greater); vectors of other lengths have no code and are dropped.
- Of equal ids the smaller vector comes first in the first codebook, null ids come last. Repeated rows are each coded.
- With fewer vectors than entries the codebooks are smaller. Null labels are one group. An empty table gives an empty result.
- Magnitudes whose squared distances could pass 64 bits raise an error. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlark.llm.common import join_groups, materialize

PARTS, ENTRIES, ROUNDS, SCALE, BITS = 4, 256, 4, 1024, 4
#: Parts looked up together.
BATCH = 512


class VaFile:
    """One codebook's entries, quantised in every coordinate; ``nearest`` is exact."""

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        self.entries = entries
        n_cells = 1 << bits
        size, width = entries.shape
        self.cells = np.empty((size, width), dtype=np.int64)
        self.low, self.high = np.zeros((width, n_cells), dtype=np.int64), np.zeros((width, n_cells), dtype=np.int64)
        for d in range(width):
            column = np.sort(entries[:, d])
            marks = np.unique(column[np.arange(1, n_cells) * size // n_cells])  # a cell begins at each mark
            self.cells[:, d] = np.searchsorted(marks, entries[:, d], side="right")
            for cell in np.unique(self.cells[:, d]):
                inside = entries[self.cells[:, d] == cell, d]
                self.low[d, cell], self.high[d, cell] = inside.min(), inside.max()

    def bounds(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bound of the squared distance from each entry (rows) to each part (columns)."""
        lower = np.zeros((len(self.entries), len(parts)), dtype=np.int64)
        upper = np.zeros_like(lower)
        for d in range(parts.shape[1]):
            below, above = self.low[d][:, None] - parts[:, d], parts[:, d] - self.high[d][:, None]
            least, most = np.maximum(np.maximum(below, above), 0), np.maximum(np.abs(below), np.abs(above))
            lower += (least * least)[self.cells[:, d]]
            upper += (most * most)[self.cells[:, d]]
        return lower, upper

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each part's nearest entry; of equally near ones the first."""
        index, error = np.empty(len(parts), dtype=np.int64), np.empty(len(parts), dtype=np.int64)
        for at in range(0, len(parts), BATCH):
            some = parts[at : at + BATCH]
            lower, upper = self.bounds(some)
            part, entry = np.nonzero((lower <= upper.min(axis=0)).T)  # every part has a candidate: the one of the least upper bound
            gap = some[part] - self.entries[entry]
            distance = np.einsum("ij,ij->i", gap, gap)
            starts = np.flatnonzero(np.diff(part, prepend=-1))
            least = np.minimum.reduceat(distance, starts)
            best = np.flatnonzero(distance == least[part])
            first = best[np.flatnonzero(np.diff(part[best], prepend=-1))]
            index[at : at + BATCH], error[at : at + BATCH] = entry[first], least
        return index, error


def integer_vectors(vectors: DataFrame, parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """vec_id, label (null or text), v (integers) of the vectors that can be coded."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where(F.col("v").isNotNull() & ~bad).withColumn("v", F.transform("v", lambda x: F.floor(x * F.lit(float(scale)))))
    kept = materialize(rows, "integer_vectors")
    sizes = kept.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n"), F.max(F.greatest(F.array_max("v"), -1 - F.array_min("v"))).alias("most"))
    common = sizes.where((F.col("size") > 0) & (F.col("size") % parts == 0)).orderBy(F.desc("n"), F.desc("size")).first()
    if common is None:
        return kept.where(F.lit(False))
    if (common.size // parts) * (2 * (common.most + 1)) ** 2 >= 1 << 62:
        raise ValueError(f"a component of {common.most / scale:g} is too large: squared distances would pass 64 bits")
    return kept.where(F.size("v") == common.size)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("v")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(batch.num_rows, -1)


def first_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """part x entry x position: the parts of the smallest ids."""
    rows = vectors.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    if not rows:
        return np.empty((parts, 0, 0), dtype=np.int64)
    found = np.array([r.v for r in rows], dtype=np.int64)
    return np.ascontiguousarray(found.reshape(len(rows), parts, -1).transpose(1, 0, 2))


def _files(sent) -> list[VaFile]:
    return [VaFile(book) for book in sent.value]


def _moved(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks after one round: each entry the floor of its parts' mean, unused ones as they were."""
    parts, entries, width = books.shape
    sent = vectors.sparkSession.sparkContext.broadcast(books)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _files(sent)
        counts, sums = np.zeros((parts, entries), dtype=np.int64), np.zeros((parts, entries, width), dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            pieces = _matrix(batch).reshape(batch.num_rows, parts, width)
            for p, file in enumerate(files):
                index, _ = file.nearest(pieces[:, p])
                order = np.argsort(index, kind="stable")
                used, starts = np.unique(index[order], return_index=True)
                counts[p] += np.bincount(index, minlength=entries)
                sums[p, used] += np.add.reduceat(pieces[order, p], starts, axis=0)
        part, entry = np.nonzero(counts)
        if len(part):
            values = pa.FixedSizeListArray.from_arrays(pa.array(sums[part, entry].ravel()), width).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(counts[part, entry]), values], ["part", "entry", "n", "total"])

    told = vectors.select("v").mapInArrow(add_up, "part long, entry long, n long, total array<long>")
    whole = told.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(width)]).alias("total"))
    after = books.copy()
    for row in whole.collect():
        after[row.part, row.entry] = np.array(row.total, dtype=np.int64) // row.n
    return after


def fit_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part x entry x position) of integer vectors after ``rounds`` rounds."""
    books = first_codebooks(vectors, parts, entries)
    for _ in range(rounds if books.size else 0):
        books = _moved(vectors, books)
    return books


def encode(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hex digits a part), error of every integer vector."""
    sent = vectors.sparkSession.sparkContext.broadcast(books)
    parts = len(books)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _files(sent)
        for batch in batches:
            if not batch.num_rows:
                continue
            pieces = _matrix(batch).reshape(batch.num_rows, parts, -1)
            found = [file.nearest(pieces[:, p]) for p, file in enumerate(files)]
            digits = np.stack([index for index, _ in found], axis=1).astype(np.uint8).tobytes().hex()
            codes = [digits[at : at + 2 * parts] for at in range(0, len(digits), 2 * parts)]
            errors = np.sum([error for _, error in found], axis=0)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(errors)], ["vec_id", "label", "code", "error"])

    return vectors.select("vec_id", "label", "v").mapInArrow(coded, "vec_id long, label string, code string, error long")


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress_vectors(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 of every vector that can be coded."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part, for 256 entries at most")
    whole = integer_vectors(vectors, parts, scale)
    books = fit_codebooks(whole, parts, entries, rounds)
    coded = materialize(encode(whole, books), "vector_codes").withColumn("label_key", F.coalesce(F.concat(F.lit("="), "label"), F.lit("")))
    groups = materialize(coded.groupBy("label_key").agg(F.sum("error").alias("label_error"), F.count("*").alias("n_rows")), "label_errors")
    joined = join_groups(coded, groups, "label_key", "n_rows")
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("label")


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same in DuckDB SQL by distances to all entries, which are exact in doubles at these magnitudes."""
    steps = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS row_no, vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v FROM embeddings"
        " WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"parts AS MATERIALIZED (SELECT row_no, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS x FROM kept, range({parts}) r(p))",
        f"b0 AS MATERIALIZED (SELECT p, row_no - 1 AS e, x AS c FROM parts WHERE row_no <= {entries})",
    ]
    distance = "list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c)"
    for k in range(rounds + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT row_no, p, any_value(x) AS x, min(({distance})::BIGINT * 256 + e) AS best FROM parts JOIN b{k} USING (p) GROUP BY row_no, p)")
        if k < rounds:
            sums = f"SELECT p, best % 256 AS e, i, floor(sum(x[i]) / count(*)) AS m FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM a{k}) GROUP BY ALL"
            steps.append(f"b{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(s.c, b.c) AS c FROM b{k} b LEFT JOIN (SELECT p, e, list(m ORDER BY i) AS c FROM ({sums}) GROUP BY p, e) s USING (p, e))")
    steps.append(f"coded AS MATERIALIZED (SELECT row_no, string_agg(printf('%02x', (best % 256)::INT), '' ORDER BY p) AS code, sum(best // 256)::BIGINT AS error FROM a{rounds} GROUP BY row_no)")
    steps.append(f"books AS (SELECT sha256(string_agg(i::BIGINT::VARCHAR, ',' ORDER BY p, e, place)) AS digest FROM (SELECT p, e, unnest(c) AS i, unnest(range(len(c))) AS place FROM b{rounds}))")
    return (
        "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, digest AS codebooks_sha256 FROM kept JOIN coded USING (row_no), books"
    )


ORACLE = oracle()
