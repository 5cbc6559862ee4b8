"""Token ids as length-delimited binary records with a separate offset index.

File format of a shard (``shard-NNNNN.rec``), repeated for each document:

    uint64  length of the payload          uint32  masked checksum of those eight bytes
    payload                                uint32  masked checksum of the payload

The payload is ``flag uint8 | doc_id int64 | ids``; bit 0 of the flag says that the document has an
id, bit 1 that ids take four bytes instead of two. All numbers are little-endian. A checksum is
CRC-32, rotated right by 15 bits plus 0xA282EAD8, so that a checksum of stored checksums stays
meaningful. (CRC-32 in place of CRC-32C: no native CRC-32C is at hand.)

The offset index (``shard-NNNNN.idx``) holds one uint64 per record, its byte offset, so that any
record can be read alone, in any order.

Documents are range-partitioned by ``doc_id`` and sorted, shard k before shard k + 1. A document's
global start is its shard's base plus its place in the shard; bases are a running sum over one row
per shard.

Defined results
- A null or empty text is the end id alone. A null ``doc_id`` sorts first and comes back as null.
- Repeated rows are each written; rows with one id, or without one, are ordered by a hash of their text, and are spread over shards
  however many they are: equal rows by a number of their own, which changes nothing.
- An empty table writes no shard and gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlark.llm import files
from siftlark.llm.common import shared_path, text_of
from siftlark.llm.tokens import END_ID, encoder, tokenizer_path

HEAD, HEAD_BYTES, HAS_ID, WIDE = "<Bq", 9, 1, 2
#: Words whose ids a worker keeps: some 200 MB, as nothing else of its size is held here.
WORDS_KEPT = 1_000_000
BATCH = 256


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def records(stream) -> Iterator[bytes]:
    """Payloads of a shard in file order; damage is an error."""
    while head := stream.read(12):
        if len(head) < 12:
            raise ValueError("cut record head")
        if masked(head[:8]) != struct.unpack("<I", head[8:])[0]:
            raise ValueError("damaged record length")
        (length,) = struct.unpack("<Q", head[:8])
        body = stream.read(length + 4)
        if len(body) < length + 4 or masked(body[:length]) != struct.unpack("<I", body[length:])[0]:
            raise ValueError("damaged record")
        yield body[:length]


def read_record(uri: str, offset: int) -> bytes:
    """One payload, found by its offset from the index."""
    store, path = files.resolve(uri)
    with store.open_input_file(path) as source:
        source.seek(offset)
        return next(records(source))


def read_offsets(uri: str) -> np.ndarray:
    store, path = files.resolve(uri)
    with store.open_input_stream(path) as source:
        return np.frombuffer(source.read(), dtype="<u8")


def write_shards(docs: DataFrame, folder: str, vocabulary: str) -> DataFrame:
    """Write all documents; one row per shard: shard, path, n_records, n_tokens. Runs when acted on."""

    def write(shard_batches):
        from pyspark import TaskContext

        first = next(shard_batches, None)
        if first is None:
            return
        shard = TaskContext.get().partitionId()
        path = f"{folder}/shard-{shard:05d}.rec"
        encode = encoder(vocabulary, WORDS_KEPT)
        flag = WIDE if encode.dtype.itemsize == 4 else 0
        end = np.array([END_ID], dtype=encode.dtype).tobytes()
        offsets, at, tokens = [], 0, 0
        with files.written(path) as out:
            batch = first
            while batch is not None:
                for start in range(0, batch.num_rows, BATCH):
                    part = batch.slice(start, BATCH)
                    for doc_id, payload in zip(part.column("doc_id").to_pylist(), encode.texts(part.column("text").to_pylist())):
                        record = frame(struct.pack(HEAD, flag | (0 if doc_id is None else HAS_ID), doc_id or 0) + payload + end)
                        out.write(record)
                        offsets.append(at)
                        at += len(record)
                        tokens += len(payload) // encode.dtype.itemsize + 1
                batch = next(shard_batches, None)
        with files.written(path[:-4] + ".idx") as out:
            out.write(np.array(offsets, dtype="<u8").tobytes())
        yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [path], "n_records": [len(offsets)], "n_tokens": [tokens]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    keyed = rows.withColumns({"text_key": F.xxhash64("text"), "place": F.rand(0)})
    ordered = keyed.repartitionByRange("doc_id", "text_key", "place").sortWithinPartitions("doc_id", "text_key", "place")
    return ordered.select("doc_id", "text").mapInArrow(write, "shard long, path string, n_records long, n_tokens long")


def read_shards(shards: DataFrame) -> DataFrame:
    """Read every record of the listed shards; ``base`` is the number of ids in earlier shards."""

    def read(batches):
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                store, place = files.resolve(path)
                rows, start = [], base
                with store.open_input_stream(place, buffer_size=1 << 20) as source:
                    for payload in records(source):
                        flag, doc_id = struct.unpack_from(HEAD, payload)
                        ids = np.frombuffer(payload, dtype="<u4" if flag & WIDE else "<u2", offset=HEAD_BYTES)
                        rows.append((doc_id if flag & HAS_ID else None, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(rows) == 10_000:
                            yield _batch_of(rows)
                            rows = []
                if rows:
                    yield _batch_of(rows)

    return shards.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _batch_of(rows: list[tuple]) -> pa.RecordBatch:
    names = ("doc_id", "start", "n_tokens", "ids_crc32")
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)


def token_records(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write ``docs`` to record files in the shared folder and read them back."""
    spark = docs.sparkSession
    folder = shared_path(spark, "token_records")
    # One row per shard: the listing grows with the number of files, not of documents.
    listed = sorted(write_shards(docs, folder, vocabulary or tokenizer_path()).collect())
    base, rows = 0, []
    for shard in listed:
        rows.append((shard.path, base))
        base += shard.n_tokens
    shards = spark.createDataFrame(rows, "path string, base long")
    return read_shards(shards.repartition(max(len(rows), 1)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records(spark.read.parquet(f"{sf_dir}/documents.parquet"))
