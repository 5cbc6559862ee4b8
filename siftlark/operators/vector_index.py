"""Approximate vector search by an inverted file over k-means cells, beside the exact one (Q4, K2).

Cells are fitted on a bounded sample of the vectors (about ``SAMPLE``, by a hash of their id, so that the choice is the same in
every run); every vector is assigned to its nearest cell and stored in that cell's folder. A query visits cells by falling
similarity of their centres until they hold a share of the vectors; only folders that some query visits are read. Scores are exact
cosines. The share is measured and not guessed: a bounded sample of stored vectors is searched exactly, and the share is the least that
holds ``TARGET`` of their neighbours, so that vectors without structure are visited more widely than clustered ones.

A cell with a third of all vectors is many files: rows are dealt by cell and hash of the id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from siftlark.operators import nearest, retrieval
from siftlark.sources.shared import shared_path, stored

SAMPLE, MOST_CELLS, ROUNDS = 50_000, 1024, 10
#: Vectors of a cell in one file, and queries that are compared in one scan.
VECTORS_A_FILE, BLOCK = 500_000, 2048
#: Vectors that are searched exactly to measure the share of vectors to visit, and the recall that they have to reach.
PROBED, TARGET = 64, 0.95


def unit(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def fit_cells(vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE) -> np.ndarray:
    """Unit centres of spherical k-means over about ``sample`` vectors (doc_id, embedding), or all if there are no more."""
    n = vectors.count()
    # The share of hashes that lets so many pass; nothing is sorted, and the choice depends on the ids alone.
    share = (1 << 32) if n <= sample else max(1, (sample << 32) // n)
    chosen = vectors.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < F.lit(share)).select("doc_id", "embedding").toArrow()
    if not chosen.num_rows:
        return np.empty((0, 0))
    column = chosen.column("embedding").combine_chunks()
    points = unit(column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(chosen.num_rows, -1))
    points = points[np.argsort(chosen.column("doc_id").to_numpy(), kind="stable")]
    n_cells = min(cells or max(1, round(len(points) ** 0.5)), MOST_CELLS, len(points))
    centres = points[np.linspace(0, len(points) - 1, n_cells).astype(int)].copy()
    for _ in range(ROUNDS):
        nearest = (points @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        length = np.linalg.norm(sums, axis=1)
        moved = np.where(length[:, None] > 1e-9, sums / np.maximum(length, 1e-9)[:, None], centres)
        if np.allclose(moved, centres, atol=1e-6):
            break
        centres = moved
    return centres


def _matrix(batch: pa.RecordBatch, column: str = "embedding") -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)


class VectorIndex:
    """Vectors in folders by cell, with the centres and the number of vectors of each cell."""

    def __init__(self, spark: SparkSession, path: str, centres: np.ndarray):
        self.spark, self.path, self.centres = spark, path, centres
        self.shares: dict[int, float] = {}

    @classmethod
    def build(cls, vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE, path: str | None = None) -> VectorIndex:
        """Index of (doc_id, embedding, ingested_at, superseded_at); vectors without length, or not of the most common size, cannot be found by cosine and are left out."""
        spark = vectors.sparkSession
        sizes = vectors.where("embedding IS NOT NULL").groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
        size = sizes["size"] if sizes else 0
        length = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double") * x, F.lit(float("nan"))))
        # NaN is greater than every number.
        usable = vectors.where((F.size("embedding") == size) & (length > 0) & (length < F.lit(float("inf"))))
        rows = usable.select("doc_id", F.col("embedding").cast("array<float>").alias("embedding"), F.unix_micros("ingested_at").alias("born"), F.unix_micros("superseded_at").alias("gone"))
        index = cls(spark, path or shared_path(spark, "vector_index"), fit_cells(rows, cells, sample))
        index._store(rows)
        return index

    def _store(self, rows: DataFrame) -> None:
        sent = self.spark.sparkContext.broadcast(self.centres)

        def assign(batches):
            for batch in batches:
                if batch.num_rows:
                    cell = (unit(_matrix(batch)) @ sent.value.T).argmax(axis=1)
                    yield batch.append_column("cell", pa.array(cell.astype(np.int32)))

        kind = rows.schema["doc_id"].dataType.simpleString()
        assigned = stored(rows.mapInArrow(assign, f"doc_id {kind}, embedding array<float>, born long, gone long, cell int"), "cell_vectors")
        counts = {r.cell: r.n for r in assigned.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # as many as there are cells
        self.sizes = np.array([counts.get(c, 0) for c in range(len(self.centres))], dtype=np.int64)
        parts = max(1, -(-int(self.sizes.max(initial=0)) // VECTORS_A_FILE))
        dealt = assigned.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts))).repartition("cell", "part").drop("part")
        dealt.write.partitionBy("cell").parquet(self.path)

    def _order(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells by falling similarity to each query, and the share of vectors in them up to each."""
        order = np.argsort(-(asked @ self.centres.T), axis=1, kind="stable")
        return order, np.cumsum(self.sizes[order], axis=1) / max(1, int(self.sizes.sum()))

    def probes(self, asked: np.ndarray, share: float) -> list[np.ndarray]:
        """Cells that each query visits: the nearest ones that hold ``share`` of the vectors."""
        order, held = self._order(asked)
        return [cells[: int((upto < share - 1e-12).sum()) + 1] for cells, upto in zip(order, held)]

    def share_for(self, limit: int, target: float = TARGET) -> float:
        """The least share of vectors that holds ``target`` of the ``limit`` nearest ones of the probed vectors."""
        if limit not in self.shares:
            from siftlark.operators import matching

            now, never = F.lit("2000-01-01").cast("timestamp"), F.lit(None).cast("timestamp")
            held = self.spark.read.parquet(self.path)
            rows = held.select("doc_id", "embedding", now.alias("ingested_at"), never.alias("superseded_at"))
            probed = rows.orderBy(F.xxhash64("doc_id", F.lit("probe")), "doc_id").limit(PROBED).select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("vector"), now.alias("as_of"))
            probed = stored(probed.dropDuplicates(["query_id"]), "probed_vectors")
            near = matching.semantic_candidates(rows, probed, limit).select("query_id", "doc_id")
            cells = near.join(held.select("doc_id", "cell"), "doc_id").select("query_id", "cell").collect()  # PROBED times limit rows
            vectors = {r.query_id: r.vector for r in probed.collect()}
            ids = list(vectors)
            order, upto = self._order(unit(np.array([vectors[i] for i in ids], dtype=float)))
            place = {i: dict(zip(cells_of.tolist(), shares.tolist())) for i, cells_of, shares in zip(ids, order, upto)}
            needed = sorted(place[r.query_id][r.cell] for r in cells)
            self.shares[limit] = needed[min(len(needed) - 1, int(len(needed) * target))] if needed else 1.0
        return self.shares[limit]

    def search(self, queries: DataFrame, limit: int = retrieval.LIMITS["semantic"], share: float | None = None) -> DataFrame:
        """query_id, doc_id, score, rank of the nearest vectors that each query's instant sees. queries: query_id, vector, as_of. ``share`` None: as measured."""
        query_type = queries.schema["query_id"].dataType.simpleString()
        width = self.centres.shape[1]
        empty = self.spark.createDataFrame([], f"query_id {query_type}, doc_id long, score double, rank int")
        if not len(self.centres):
            return empty
        share = self.share_for(limit) if share is None else share
        held = self.spark.read.parquet(self.path)
        id_type = held.schema["doc_id"].dataType.simpleString()
        asked = queries.where(F.size("vector") == width).select("query_id", F.col("vector").cast("array<double>").alias("vector"), F.unix_micros("as_of").alias("as_of"))
        n = asked.count()
        blocks = max(1, -(-n // BLOCK))
        asked = stored(asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))), "vector_queries")
        found = None
        for block in range(blocks):
            rows = [r for r in asked.where(F.col("block") == block).collect() if np.linalg.norm(r.vector) > 0]
            if not rows:
                continue
            vectors = unit(np.array([r.vector for r in rows], dtype=float))
            visits = self.probes(vectors, share)
            by_cell: dict[int, list[int]] = {}
            for i, cells in enumerate(visits):
                for cell in cells.tolist():
                    by_cell.setdefault(cell, []).append(i)
            sent = self.spark.sparkContext.broadcast(([r.query_id for r in rows], vectors, np.array([r.as_of for r in rows], dtype=np.int64), by_cell))
            scan = _scan(sent, limit, pa.string() if query_type == "string" else pa.int64(), to_arrow_type(held.schema["doc_id"].dataType))
            part = held.where(F.col("cell").isin(sorted(by_cell))).mapInArrow(scan, f"query_id {query_type}, doc_id {id_type}, score double")
            part = stored(retrieval.ranked(part, limit), f"block_{block}")
            found = part if found is None else found.unionByName(part)
        return empty if found is None else found


def _scan(sent, limit: int, query_type: pa.DataType, doc_type: pa.DataType):
    """Compares vectors with the queries that visit their cell; of each task and query the best ``limit`` go on."""

    def scan(batches):
        ids, asked, as_of, by_cell = sent.value
        kept, never = nearest.Best(len(ids), limit), np.iinfo(np.int64).max
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = batch.column("cell").to_numpy(zero_copy_only=False)
            matrix, names = unit(_matrix(batch)), nearest.ids_of(batch.column("doc_id"))
            born, gone = (batch.column(c).fill_null(never).to_numpy(zero_copy_only=False) for c in ("born", "gone"))
            for cell in np.unique(cells).tolist():
                at, mine = np.flatnonzero(cells == cell), np.array(by_cell.get(cell, []), dtype=int)

                def scores(mine, part, low, at=at):
                    rows = at[low : low + len(part)]
                    found = np.round(asked[mine] @ part.T, 12)
                    seen = (born[rows][None, :] <= as_of[mine][:, None]) & (gone[rows][None, :] > as_of[mine][:, None])
                    return np.where(seen, found, -np.inf)

                kept.add(mine, names[at], matrix[at], scores)
        for q, d, s in kept.rows():
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in q.tolist()], query_type), nearest.id_column(d, doc_type), pa.array(s, pa.float64())], ["query_id", "doc_id", "score"])

    return scan


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """query_id, n_exact, n_found and recall of each query of the exact result (query_id, doc_id)."""
    hits = exact.select("query_id", "doc_id").join(approximate.select("query_id", "doc_id", F.lit(1).alias("hit")), ["query_id", "doc_id"], "left")
    return hits.groupBy("query_id").agg(F.count("*").alias("n_exact"), F.count("hit").alias("n_found"), (F.count("hit") / F.count("*")).alias("recall"))
