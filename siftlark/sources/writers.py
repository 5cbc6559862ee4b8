"""Files with contents of their own, written inside tasks through Arrow's file systems (S20, O-files)."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _put(folder: str, name: str, content: bytes) -> None:
    """A file that appears when it is complete; a second attempt of a task puts the same bytes in its place."""
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    hidden = f"{base}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(hidden) as out:
        out.write(content)
    store.move(hidden, f"{base}/{name}")


def write_files(files: DataFrame, folder: str) -> int:
    """One file for each row (name, content text or binary); the number of files."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
                _put(folder, name, content)
                n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return files.select("name", F.col("content").cast("binary").alias("content")).mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_archives(members: DataFrame, folder: str) -> int:
    """One ZIP archive for each ``archive`` name with its rows (member_no, member, content) in order; an archive is made in one task's memory."""

    def write(key, table):
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("member_no", "member", "content"))))
        made = io.BytesIO()
        with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as out:
            for _, member, content in rows:
                out.writestr(zipfile.ZipInfo(member), content)
        _put(folder, key[0].as_py(), made.getvalue())
        return pa.table({"n": pa.array([1], pa.int64())})

    return members.groupBy("archive").applyInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
