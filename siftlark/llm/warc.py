"""WARC archives as seekable Zstandard bundles, with revisit records for repeated payloads.

An archive (``part-NNNNN.warc.zst``) is a row of independent Zstandard frames, each of about
``FRAME_BYTES`` of whole WARC/1.1 records, then a skippable frame that holds the seek table
(sizes and a checksum of each frame, then the number of frames and the closing magic number). Any
Zstandard reader reads the archive from end to end; a reader with the seek table or the index opens
one frame alone. The index has, for every record, its archive, where its frame starts and its
offset and length inside the unpacked frame. Its key is the record's WARC-Record-ID, which is made
from the archive and the record's number in it, so repeated pages and pages without an id have records of their own.

A record's block is an HTTP response. A revisit keeps only the HTTP head, whose Content-Length is
the full payload's; its digest header is the full payload's too. It names its response by target URI
and date, as the format recommends, and by page id.

Which page holds a payload is decided from digests alone (one row per payload after map-side
aggregation); pages then get their role by a join on ``page_id``, so a payload that a third of all
pages share never gathers in one task.

Defined results
- A null html is an empty payload. A null url gives the target ``urn:page:<id>``.
- Of payloads of at least ``revisit_from`` bytes that are equal, the smallest ``page_id`` is the
  response, null ids last; repeated rows of that very id are all responses.
- A frame holds a record whole, however long; the format's sizes end at 4 GiB, above what a row can hold.
- A null ``page_id`` comes back as null. An empty table gives no archives and an empty result.
- Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlark.llm import files
from siftlark.llm.common import join_groups, materialize, shared_path, text_of

FRAME_BYTES = 1 << 20
LEVEL = 3

# Fixed values of the seekable Zstandard format and of WARC 1.1.
SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
INDEX_SCHEMA = "record_id string, page_id long, path string, frame long, frame_bytes long, offset long, length long"
RECORD_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(archive: str, number: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(RECORD_NAMESPACE, f'{archive}#{number}')}>"


def target_uri(page_id: int | None, url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or f"urn:page:{page_id}")


def build_record(identity: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, refers_url: str | None, date: str) -> bytes:
    """A response, or a revisit of ``refers_to``."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {identity}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target_uri(page_id, url)}",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        f"WARC-Block-Digest: sha1:{digest_of(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To-Target-URI: {target_uri(refers_to, refers_url)}", f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(frame: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of every record of an unpacked frame."""
    at = 0
    while at < len(frame):
        end = frame.index(b"\r\n\r\n", at)
        first, *rest = frame[at:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in rest)}
        stop = end + 4 + int(headers["content-length"])
        block = frame[end + 4 : stop]
        if frame[stop : stop + 4] != b"\r\n\r\n" or "sha1:" + digest_of(block) != headers["warc-block-digest"]:
            raise ValueError("damaged WARC record")
        yield headers, block
        at = stop + 4


def described(headers: dict[str, str], block: bytes) -> tuple:
    """The result row of a record, checked against its payload."""
    head, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"(?m)^Content-Length: (\d+)", head)[1])
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    kind = headers["warc-type"]
    if kind == "response" and (len(payload) != length or digest_of(payload) != digest):
        raise ValueError("payload does not match its record")
    number = lambda name: int(headers[name]) if name in headers else None
    return number("x-page-id"), length, digest, kind, number("x-refers-to-page-id")


def seek_table(frames: list[tuple[int, int, int]]) -> bytes:
    """The closing skippable frame for (packed size, unpacked size, checksum) of each frame."""
    body = b"".join(struct.pack("<III", *f) for f in frames) + struct.pack("<IBI", len(frames), CHECKSUMS, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(source, size: int) -> list[tuple[int, int, int, int]]:
    """(start, packed size, unpacked size, checksum) of each frame."""
    source.seek(size - 9)
    count, flags, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE or flags != CHECKSUMS:
        raise ValueError("no seek table")
    source.seek(size - 9 - 12 * count)
    found, start = [], 0
    for packed, raw, check in struct.iter_unpack("<III", source.read(12 * count)):
        found.append((start, packed, raw, check))
        start += packed
    return found


def unpack(packed: bytes, raw_size: int | None = None, check: int | None = None) -> bytes:
    import xxhash
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(packed)
    if check is not None and (len(raw) != raw_size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check):
        raise ValueError("damaged frame")
    return raw


def read_one(path: str, frame: int, frame_bytes: int, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record through its index row: only its frame is read."""
    store, place = files.resolve(path)
    with store.open_input_file(place) as source:
        source.seek(frame)
        raw = unpack(source.read(frame_bytes))
    return next(parse_records(raw[offset : offset + length]))


def roles(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """page_id, digest, refers_to and refers_url of each distinct (page, payload) that is a revisit."""
    body = F.encode(text_of("html"), "UTF-8")
    rows = materialize(
        pages.select(F.col("page_id").cast("long").alias("page_id"), F.unhex(F.sha1(body)).alias("digest"), F.octet_length(body).alias("n_bytes"), F.col("url").cast("string").alias("url")),
        "payloads",
    )
    groups = materialize(rows.groupBy("digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"), F.count("*").alias("n_rows")), "payload_groups")
    groups = groups.select("digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"), "n_rows")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")) & (F.col("n_bytes") >= revisit_from)
    found = join_groups(rows.drop("url"), groups, "digest", "n_rows")
    return found.select("page_id", "digest", F.when(again, F.col("first_id")).alias("refers_to"), F.col("first_url").alias("refers_url")).where("refers_to IS NOT NULL").distinct()


def write_archives(pages: DataFrame, folder: str, revisit_from: int = 0, frame_bytes: int = FRAME_BYTES, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write one archive per partition; the index, one row per record. Runs when acted on."""

    def write(batches):
        import xxhash
        import zstandard
        from pyspark import TaskContext

        first = next(batches, None)
        if first is None:
            return
        path = f"{folder}/part-{TaskContext.get().partitionId():05d}.warc.zst"
        packer = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        frames, index, waiting, size, start, number = [], [], [], 0, 0, 0

        with files.written(path) as out:

            def close() -> None:
                nonlocal size, start
                raw = b"".join(record for _, _, record in waiting)
                packed = packer.compress(raw)
                out.write(packed)
                frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
                offset = 0
                for identity, page_id, record in waiting:
                    index.append((identity, page_id, path, start, len(packed), offset, len(record)))
                    offset += len(record)
                waiting.clear()
                size, start = 0, start + len(packed)

            batch = first
            while batch is not None:
                for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to", "refers_url"))):
                    page_id, url, html, refers_to, refers_url = row
                    identity = record_id(path, number)
                    number += 1
                    record = build_record(identity, page_id, url, html.encode(), refers_to, refers_url, date)
                    if waiting and size + len(record) > frame_bytes:
                        close()
                    waiting.append((identity, page_id, record))
                    size += len(record)
                batch = next(batches, None)
            if waiting:
                close()
            out.write(seek_table(frames))
        columns = list(zip(*index))
        kinds = [pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["record_id", "page_id", "path", "frame", "frame_bytes", "offset", "length"])

    revisits = roles(pages, revisit_from).select(F.col("page_id").alias("revisit_id"), F.col("digest").alias("revisit_digest"), "refers_to", "refers_url")
    body = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_of("html").alias("html"))
    same = body["page_id"].eqNullSafe(revisits["revisit_id"]) & (F.unhex(F.sha1(F.encode(body["html"], "UTF-8"))) == revisits["revisit_digest"])
    dealt = body.join(revisits, same, "left").select("page_id", "url", "html", "refers_to", "refers_url")
    return dealt.sortWithinPartitions("page_id").mapInArrow(write, INDEX_SCHEMA)


def read_archives(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Every record of the archives, frame by frame through their seek tables."""

    def read(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, place = files.resolve(path)
                with store.open_input_file(place) as source:
                    for start, packed, raw_size, check in read_seek_table(source, source.size()):
                        source.seek(start)
                        raw = unpack(source.read(packed), raw_size, check)
                        columns = list(zip(*(described(*r) for r in parse_records(raw))))
                        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    listed = spark.createDataFrame([(p,) for p in paths], "path string")
    # Files are read in turn by a few tasks for each core, however many there are.
    tasks = max(min(len(paths), 8 * spark.sparkContext.defaultParallelism), 1)
    return listed.repartition(tasks).mapInArrow(read, RECORD_SCHEMA)


def archive_round_trip(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read all records back from them."""
    spark = pages.sparkSession
    index = materialize(write_archives(pages, shared_path(spark, "warc"), revisit_from), "warc_index")
    # One path per archive: the list grows with the number of files, not of pages.
    paths = sorted(r.path for r in index.select("path").distinct().collect())
    return read_archives(spark, paths)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
