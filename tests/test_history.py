"""Incremental version history against one build of all arrivals."""

import datetime as dt
import random
import shutil

import pytest

from siftlark.operators import history, versions

ARRIVAL = "key string, version_id string, source_hash string, matching_hash string, retrieved_at timestamp, ingested_at timestamp, seq long, title string"
BEGAN = dt.datetime(2024, 1, 1)


def arrivals(seed, n, keys=30):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        at = BEGAN + dt.timedelta(hours=draw.randint(0, 200))
        content = draw.choice("ABCD")
        rows.append((f"k{draw.randint(0, keys)}", f"v{i}", content, content in "AB" and "m1" or "m2", at, at, i, f"title {content}"))
    return rows


def rows_of(df):
    names = sorted(df.columns)
    return sorted((tuple(r[n] for n in names) for r in df.select(*names).collect()), key=repr)


@pytest.mark.parametrize("seed, cuts", [(1, (0, 40, 41, 90, 150)), (2, (0, 150)), (3, (0, 75, 150))])
def test_deltas_make_the_same_history(spark, tmp_path, seed, cuts):
    rows = arrivals(seed, 150)
    store = history.VersionHistory(spark, (tmp_path / "h").as_uri(), buckets=8)
    assert store.current() == {}
    for a, b in zip(cuts, cuts[1:]):
        store.merge(spark.createDataFrame(rows[a:b], ARRIVAL))
        assert rows_of(store.read()) == rows_of(versions.build_versions(spark.createDataFrame(rows[:b], ARRIVAL)))


def test_late_deltas_and_repeats(spark, tmp_path):
    rows = sorted(arrivals(4, 80), key=lambda r: r[6], reverse=True)  # the last arrivals come first
    store = history.VersionHistory(spark, (tmp_path / "h").as_uri(), buckets=4)
    for part in (rows[:30], rows[30:60], rows[:50], rows[60:], rows):
        store.merge(spark.createDataFrame(part, ARRIVAL))
    assert rows_of(store.read()) == rows_of(versions.build_versions(spark.createDataFrame(rows, ARRIVAL)))
    assert store.merge(spark.createDataFrame(rows, ARRIVAL)) == set() and store.merge(spark.createDataFrame([], ARRIVAL)) == set()


def test_only_touched_buckets_are_written(spark, tmp_path):
    store = history.VersionHistory(spark, (tmp_path / "h").as_uri(), buckets=16)
    store.merge(spark.createDataFrame(arrivals(5, 200), ARRIVAL))
    before = {str(p): p.stat().st_mtime_ns for p in (tmp_path / "h" / "versions").rglob("*.parquet")}
    one = [("k7", "new", "Z", "m9", BEGAN, BEGAN + dt.timedelta(days=90), 999, "t")]
    (touched,) = store.merge(spark.createDataFrame(one, ARRIVAL))
    after = {str(p): p.stat().st_mtime_ns for p in (tmp_path / "h" / "versions").rglob("*.parquet")}
    assert before.items() <= after.items() and set(after) - set(before)
    assert all("/generation=00000002-" in p and f"/bucket={touched}/" in p for p in set(after) - set(before))
    last = [r for r in store.read().where("key = 'k7'").collect() if r.superseded_by == "new"]
    assert len(last) == 1 and last[0].superseded_at == BEGAN


def test_a_merge_that_failed_before_its_manifest_is_not_seen(spark, tmp_path):
    rows = arrivals(6, 60)
    store = history.VersionHistory(spark, (tmp_path / "h").as_uri(), buckets=4)
    store.merge(spark.createDataFrame(rows[:30], ARRIVAL))
    wanted = rows_of(store.read())
    shutil.copytree(tmp_path / "h" / "manifest", tmp_path / "kept")
    store.merge(spark.createDataFrame(rows[30:], ARRIVAL))
    shutil.rmtree(tmp_path / "h" / "manifest")
    shutil.copytree(tmp_path / "kept", tmp_path / "h" / "manifest")
    again = history.VersionHistory(spark, (tmp_path / "h").as_uri(), buckets=4)
    assert rows_of(again.read()) == wanted
    again.merge(spark.createDataFrame(rows[30:], ARRIVAL))
    assert rows_of(again.read()) == rows_of(versions.build_versions(spark.createDataFrame(rows, ARRIVAL)))
