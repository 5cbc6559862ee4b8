"""A paged source that is read through opaque cursors (S2, S3, cursor-paged incremental source).

Every page names the cursor of the next one, so that the chain of cursors can only be walked in order. The driver
walks it and learns cursors, never rows; each page then is a partition of its own, fetched by a task, or pages that the
transport holds together are one. The offset of the stream
is the chain so far: a restarted query goes on at the cursor where the last batch ended, and a batch that is run
again fetches the same pages by the same cursors.

A selection ends at a page without a next cursor, or after ``last_page`` pages. A next cursor that is blank, or that the chain
holds already, ends it with an error row; so does a page that does not hold a list of studies. A page that is
not there yet is waited for.

Options
- ``transport``: ``module:name`` of a callable that takes the options and gives an object with ``next_cursor(cursor)`` (None at the
  end; raises ``PageMissing``) and ``studies(cursor)`` (JSON texts, or None for an invalid page). Default: pages saved by ``save_pages``.
- ``path``: where saved pages are. ``first_page``, ``last_page``: pages are counted from 1; earlier ones are walked and not read.
- ``pages_a_batch``: at most so many pages in one micro-batch (default: all that are there).
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from siftlark.sources.readers import MAX_PAGES

SCHEMA = "page_no int, cursor string, place int, study string, problem string"
FIELDS = pa.schema([("page_no", pa.int32()), ("cursor", pa.string()), ("place", pa.int32()), ("study", pa.string()), ("problem", pa.string())])
#: The cursor of the first page.
START = ""
#: Pages of a file that are read at once, and about the bytes of one of its row groups.
PAGES_READ, GROUP_BYTES = 16, 8 << 20
REPEATED, BLANK, INVALID_PAGE = "repeated_cursor", "blank_cursor", "invalid_page"


class PageMissing(LookupError):
    """No page is known under this cursor (yet)."""


class SavedPages:
    """Pages as a Parquet table of cursor, next_cursor and studies.

    A walk reads the cursors of the whole table once. Pages that lie together in a file are fetched together, so that
    each part of a file is read once, however many pages it holds.
    """

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.known: dict[str, str | None] | None = None

    def _files(self):
        import pyarrow.dataset as ds
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(self.path)
        if store.get_file_info(folder).type == fs.FileType.NotFound:
            return None
        return ds.dataset(folder, filesystem=store, format="parquet")

    def next_cursor(self, cursor: str) -> str | None:
        if self.known is None:
            files = self._files()
            self.known = {}
            for batch in files.to_batches(columns=["cursor", "next_cursor"]) if files else ():
                for at, after in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    self.known.setdefault(at, after)
        if cursor not in self.known:
            raise PageMissing(cursor)
        return self.known[cursor]

    def studies(self, cursor: str) -> list[str] | None:
        for _, studies in self.studies_of([cursor]):
            return studies
        raise PageMissing(cursor)

    def together(self, cursors: list[str]) -> Iterator[tuple[list[str], tuple[str, int]]]:
        """The cursors by row group of the files, with its place."""
        files, wanted = self._files(), set(cursors)
        for file in files.get_fragments() if files else ():
            for group in file.split_by_row_group():
                found = [c for c in group.to_table(columns=["cursor"]).column(0).to_pylist() if c in wanted]
                wanted.difference_update(found)
                if found:
                    yield found, (file.path, group.row_groups[0].id)
        if wanted:
            raise PageMissing(sorted(wanted)[0])

    def studies_of(self, cursors: list[str], place: tuple[str, int] | None = None) -> Iterator[tuple[str, list[str] | None]]:
        """The pages of these cursors in the order of the files, a few at a time; ``place`` is the row group that holds them all."""
        import pyarrow.dataset as ds

        files, wanted = self._files(), ds.field("cursor").isin(cursors)
        if files is None:
            return
        if place:
            file = next(f for f in files.get_fragments() if f.path == place[0])
            batches = file.subset(row_group_ids=[place[1]]).to_batches(columns=["cursor", "studies"], filter=wanted, batch_size=PAGES_READ)
        else:
            batches = files.to_batches(columns=["cursor", "studies"], filter=wanted, batch_size=PAGES_READ)
        left = set(cursors)
        for batch in batches:
            for cursor, studies in zip(batch.column(0), batch.column(1)):
                if (at := cursor.as_py()) in left:
                    left.discard(at)
                    yield at, studies.as_py()


def save_pages(pages: DataFrame, path: str) -> None:
    """Append pages (cursor, next_cursor, studies: JSON texts or null) for ``SavedPages``, in row groups of a few megabytes, each of which a task fetches."""
    rows = pages.select(F.col("cursor").cast("string"), F.col("next_cursor").cast("string"), F.col("studies").cast("array<string>"))
    rows.sort("cursor").write.mode("append").option("parquet.block.size", GROUP_BYTES).parquet(path)


def transport_of(options: dict[str, str]):
    named = options.get("transport")
    if not named:
        return SavedPages(options)
    module, _, name = named.partition(":")
    return getattr(importlib.import_module(module), name)(options)


class Page(InputPartition):
    """One page of the chain; ``problem`` is what ended the chain behind it."""

    def __init__(self, number: int, cursor: str, problem: str | None, wanted: bool):
        self.number, self.cursor, self.problem, self.wanted = number, cursor, problem, wanted


class Pages(InputPartition):
    """Pages that the transport fetches together."""

    def __init__(self, pages: list[Page], place: Any):
        self.pages, self.place = pages, place


class Chain:
    """The walk: cursors of the pages so far, the cursor to go on with, and how it ended."""

    def __init__(self, options: dict[str, str]):
        self.transport = transport_of(options)
        self.first, self.last = int(options.get("first_page", 1)), int(options.get("last_page", MAX_PAGES))
        if not 1 <= self.first <= self.last:
            raise ValueError("invalid page range")
        self.step = int(options.get("pages_a_batch", 0)) or self.last

    @staticmethod
    def begin() -> dict:
        return {"cursors": "[]", "next": START, "ended": "", "page_no": 0}

    def onward(self, offset: dict) -> dict:
        """The offset after the pages that are there now, ``pages_a_batch`` at most."""
        cursors, following, ended = json.loads(offset["cursors"]), offset["next"], offset["ended"]
        held = set(cursors)
        for _ in range(self.step):
            if ended:
                break
            try:
                after = self.transport.next_cursor(following)
            except PageMissing:
                break
            cursors.append(following)
            held.add(following)
            if after is None or len(cursors) == self.last:
                ended = "last"
            elif not after.strip():
                ended = BLANK
            elif after in held:
                ended = REPEATED
            else:
                following = after
        return {"cursors": json.dumps(cursors), "next": following, "ended": ended, "page_no": len(cursors)}

    def pages(self, start: dict, end: dict) -> list[Page]:
        cursors = json.loads(end["cursors"])
        found = []
        for number in range(start["page_no"] + 1, end["page_no"] + 1):
            problem = end["ended"] if number == len(cursors) and end["ended"] in (BLANK, REPEATED) else None
            if number >= self.first or problem:
                found.append(Page(number, cursors[number - 1], problem, number >= self.first))
        return found

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """The pages, or groups of them if the transport knows pages that lie together."""
        pages = self.pages(start, end)
        if not hasattr(self.transport, "together"):
            return pages
        wanted = {p.cursor: p for p in pages if p.wanted}
        groups = [Pages([wanted[c] for c in cursors], place) for cursors, place in self.transport.together(list(wanted))] if wanted else []
        return groups + [p for p in pages if not p.wanted]

    def rows(self, part: Page | Pages) -> Iterator[pa.RecordBatch]:
        if isinstance(part, Page):
            yield self._rows(part, self.transport.studies(part.cursor) if part.wanted else None)
            return
        left = {p.cursor: p for p in part.pages}
        for cursor, studies in self.transport.studies_of(list(left), part.place):
            yield self._rows(left.pop(cursor), studies)
        if left:
            raise PageMissing(next(iter(left)))

    @staticmethod
    def _rows(page: Page, studies: list[str] | None) -> pa.RecordBatch:
        rows = []
        if page.wanted:
            if studies is None:
                rows.append((0, None, INVALID_PAGE))
            else:
                rows += [(place, study, None) for place, study in enumerate(studies, 1)]
        if page.problem:
            rows.append((0, None, page.problem))
        columns = [[page.number] * len(rows), [page.cursor] * len(rows), *map(list, zip(*rows))] if rows else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FIELDS)], schema=FIELDS)


class CursorStream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.options, self.at = options, None

    def initialOffset(self) -> dict:
        return Chain.begin()

    def latestOffset(self) -> dict:
        self.at = Chain(self.options).onward(self.at or self.initialOffset())
        return self.at

    def partitions(self, start: dict, end: dict) -> list[Page]:
        # A restarted query first plans its last batch anew: from there the walk goes on.
        if self.at is None or self.at["page_no"] < end["page_no"]:
            self.at = end
        return Chain(self.options).partitions(start, end)

    def read(self, partition: Page | Pages) -> Iterator[pa.RecordBatch]:
        return Chain(self.options).rows(partition)


class CursorScan(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[Page]:
        chain = Chain(self.options | {"pages_a_batch": "0"})
        return chain.partitions(chain.begin(), chain.onward(chain.begin())) or [Page(0, START, None, False)]

    def read(self, partition: Page | Pages) -> Iterator[pa.RecordBatch]:
        return Chain(self.options).rows(partition)


class CursorPages(DataSource):
    """``spark.read`` and ``spark.readStream`` of format ``cursor_pages``."""

    @classmethod
    def name(cls) -> str:
        return "cursor_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return CursorScan(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return CursorStream(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CursorPages)


def append_pages(spark: SparkSession, options: dict[str, str], target: str, checkpoint: str) -> None:
    """Append the studies of all pages that are there to a Parquet table, then stop; called again it goes on at the cursor."""
    register(spark)
    rows = spark.readStream.format("cursor_pages").options(**options).load()
    rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
