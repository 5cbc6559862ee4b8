"""Cursor-paged source and leased claims."""

import datetime as dt
import random

import pytest

from siftlark.sources import cursor
from siftlark.streaming import claims

PAGES = "cursor string, next_cursor string, studies array<string>"


def chain(spark, path, pages):
    cursor.save_pages(spark.createDataFrame(pages, PAGES), path)


def rows_of(df):
    return sorted((r.page_no, r.place, r.study, r.problem) for r in df.collect())


def test_stream_goes_on_at_the_cursor(spark, tmp_path):
    at = lambda name: (tmp_path / name).as_uri()
    options = {"path": at("pages"), "last_page": "10"}
    run = lambda: cursor.append_pages(spark, options, at("rows"), at("checkpoint"))
    read = lambda: rows_of(spark.read.schema(cursor.SCHEMA).parquet(at("rows")))
    run()  # no page is there yet
    chain(spark, at("pages"), [("", "a", ["s1", "s2"]), ("a", "b", ["s3"])])
    run()
    assert read() == [(1, 1, "s1", None), (1, 2, "s2", None), (2, 1, "s3", None)]
    run()  # nothing new
    chain(spark, at("pages"), [("b", "c", None), ("c", "a", [])])
    run()
    run()
    assert read() == [(1, 1, "s1", None), (1, 2, "s2", None), (2, 1, "s3", None), (3, 0, None, "invalid_page"), (4, 0, None, "repeated_cursor")]


@pytest.mark.parametrize("after, problem", [("a", "repeated_cursor"), ("b", "repeated_cursor"), (" ", "blank_cursor"), ("", "blank_cursor"), (None, None)])
def test_ends_of_a_chain(spark, tmp_path, after, problem):
    path = (tmp_path / "pages").as_uri()
    chain(spark, path, [("", "a", ["x"]), ("a", "b", ["y"]), ("b", after, ["z"])])
    cursor.register(spark)
    read = lambda **o: rows_of(spark.read.format("cursor_pages").options(path=path, **o).load())
    error = [(3, 0, None, problem)] if problem else []
    assert read() == sorted([(1, 1, "x", None), (2, 1, "y", None), (3, 1, "z", None), *error])
    assert read(first_page="2", last_page="2") == [(2, 1, "y", None)]
    assert read(first_page="3") == sorted([(3, 1, "z", None), *error])


def test_saved_pages_are_read_by_row_group(spark, tmp_path, monkeypatch):
    """Neither a scan of the table for every cursor of the walk, nor a task for every page."""
    path = (tmp_path / "pages").as_uri()
    chain(spark, path, [(str(k) if k else "", str(k + 1) if k < 299 else None, None if k % 7 == 3 else [f"s{k}"]) for k in range(300)])
    scans = []
    files = cursor.SavedPages._files
    monkeypatch.setattr(cursor.SavedPages, "_files", lambda self: scans.append(1) or files(self))
    walk = cursor.Chain({"path": path, "last_page": "300"})
    end = walk.onward(walk.begin())
    parts = walk.partitions(walk.begin(), end)
    rows = [row for part in parts for batch in walk.rows(part) for row in batch.to_pylist()]
    assert len(parts) < 20 and len(scans) == len(parts) + 2
    assert sorted((r["page_no"], r["study"], r["problem"]) for r in rows) == [(k + 1, None, "invalid_page") if k % 7 == 3 else (k + 1, f"s{k}", None) for k in range(300)]


class Counted:
    """A transport without files: page n leads to n + 1, without end."""

    def __init__(self, options):
        self.size = int(options["size"])

    def next_cursor(self, cursor):
        return str(int(cursor or 0) + 1)

    def studies(self, cursor):
        return [f"{cursor}:{k}" for k in range(self.size)]


def test_injected_transport_is_bounded_to_ten_pages(spark):
    cursor.register(spark)
    found = spark.read.format("cursor_pages").options(transport="tests.test_streams:Counted", size="3").load()
    assert found.count() == 30 and found.selectExpr("max(page_no) AS m").first().m == 10


def test_bounded_batches_walk_the_same_chain():
    options = {"transport": "tests.test_streams:Counted", "size": "1", "pages_a_batch": "3"}
    stream, at, pages = cursor.CursorStream(options), cursor.Chain.begin(), []
    for _ in range(6):
        end = stream.latestOffset()
        pages += [p.number for p in stream.partitions(at, end)]
        if len(pages) == 6:  # a restarted reader first plans the last batch again
            stream = cursor.CursorStream(options)
            assert [p.number for p in stream.partitions(at, end)] == [4, 5, 6]
        at = end
    assert pages == list(range(1, 11)) and at["ended"] == "last"
    with pytest.raises(ValueError, match="page range"):
        cursor.Chain({"transport": "tests.test_streams:Counted", "size": "1", "first_page": "4", "last_page": "3"})


DAY = dt.timedelta(days=1)
BEGAN = dt.datetime(2024, 1, 1)


def day(n):
    return BEGAN + n * DAY


def plain_claims(log, lease, most, end):
    """Claims of a log read in one go up to the instant ``end``."""
    found = []
    for job in {r[0] for r in log}:
        state, attempt, until = None, 0, None

        def expire(now):
            nonlocal state, attempt, until
            while state == "held" and until <= now:
                found.append((job, attempt, "expired" if attempt < most else "failed", until))  # noqa: B023
                if attempt == most:
                    state = "done"
                    return
                attempt += 1
                found.append((job, attempt, "claimed", until))  # noqa: B023
                until = until + lease

        for _, event, of, at in sorted((r for r in log if r[0] == job), key=lambda r: (r[3], claims.ORDER.index(r[1]))):
            expire(at)
            if event == "queued" and state is None:
                state, attempt, until = "held", 1, at + lease
                found.append((job, 1, "claimed", at))
            elif state == "held" and of in (None, attempt):
                if event == "renewed":
                    until = at + lease
                elif event != "queued":
                    state = "done"
                    found.append((job, attempt, event, at))
        expire(end)
    return sorted(found)


@pytest.mark.parametrize("cuts", [(0, 60), (0, 13, 31, 60)])
def test_claims_do_not_depend_on_batches(spark, tmp_path, cuts):
    draw = random.Random(4)
    log = []
    for k in range(40):
        begin = draw.randint(0, 30)
        log.append((f"j{k}", "queued", None, day(begin)))
        for _ in range(draw.randint(0, 5)):
            event = draw.choice(["queued", "queued", "renewed", "completed", "failed", "cancelled"])
            log.append((f"j{k}", event, draw.choice([None, 1, 2]), day(draw.randint(begin, 58))))
    log += [("early", "completed", None, day(3)), ("end", "queued", None, day(59))]
    path, target, checkpoint = ((tmp_path / n).as_uri() for n in ("log", "claims", "checkpoint"))
    for a, b in zip(cuts, cuts[1:]):
        claims.append_log(spark.createDataFrame([r for r in log if day(a) <= r[3] < day(b)], claims.LOG), path)
        claims.run_claims(spark, path, target, checkpoint, 7 * DAY, 3)
    claims.run_claims(spark, path, target, checkpoint, 7 * DAY, 3)  # nothing new: nothing is written
    # A crash after the last batch wrote its rows and before it was committed: the batch is run again.
    last = max((f for f in (tmp_path / "checkpoint" / "commits").iterdir() if f.name.isdigit()), key=lambda f: int(f.name))
    last.with_name(f".{last.name}.crc").unlink(missing_ok=True)
    last.unlink()
    claims.run_claims(spark, path, target, checkpoint, 7 * DAY, 3)
    got = sorted((r.job_id, r.attempt, r.status, r.at) for r in spark.read.schema(claims.CLAIMS).parquet(target).collect())
    assert got == plain_claims(log, 7 * DAY, 3, day(59))
    assert len([r for r in got if r[1:3] == (1, "claimed")]) == 41


def test_late_finish_of_an_old_attempt_changes_nothing():
    job = claims.Lease("j", None, 10, 2)
    for event, attempt, at in (("queued", None, 0), ("queued", None, 5), ("completed", 1, 10), ("renewed", 2, 15), ("completed", 2, 24), ("failed", None, 25)):
        job.event(event, attempt, at)
    assert job.rows == [(1, "claimed", 0), (1, "expired", 10), (2, "claimed", 10), (2, "completed", 24)]
    tired = claims.Lease("j", ("claimed", 2, 20), 10, 2)
    tired.expire(100)
    assert tired.rows == [(2, "failed", 20)] and tired.status == "failed"


def test_state_hears_of_changes_only():
    """A job that has ended costs one read of its state, however often it is queued again."""
    calls = []

    class State:
        value = None

        def exists(self):
            calls.append("exists")
            return self.value is not None

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

    class Handle:
        def registerTimer(self, at):
            calls.append("register")

        def deleteTimer(self, at):
            calls.append("delete")

    jobs = claims.Claims(7 * DAY, 3)
    jobs.handle, jobs.state = Handle(), State()
    hear = lambda *events: list(jobs._after(("j",), lambda job: [job.event(e, None, claims._micros(day(n))) for e, n in events]))
    assert len(hear(("queued", 1))) == 1 and calls == ["get", "update", "register"] or calls == ["get", "register", "update"]
    hear(("completed", 2))
    calls.clear()
    assert hear(("queued", 3)) == [] and calls == ["get"]
