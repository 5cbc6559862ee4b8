import hashlib
import re

from pyspark.sql import functions as F

from siftlark.llm import exact_dedup


def brute(rows):
    key = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(key(t), []).append(i)
    out = []
    seen = set()
    for i, t, *_ in rows:
        ids = groups[key(t)]
        known = [x for x in ids if x is not None]
        keep = min(known) if known else None
        kept = i == keep and key(t) not in seen
        seen |= {key(t)} if kept else set()
        out.append((i, keep, len(ids), kept, hashlib.sha256(key(t).encode()).hexdigest()))
    return out


def tidy(rows):
    return sorted(map(tuple, rows), key=str)


def test_matches_brute_force_with_clashing_columns(make_docs, odd_rows):
    assert tidy(exact_dedup.exact_dedup(make_docs(odd_rows, clashing=True), 4).collect()) == tidy(brute(odd_rows))


def test_later_batches_meet_the_index(spark, make_docs):
    index = exact_dedup.DigestIndex.fresh(spark, 4)
    first = [(5, "a  b", "en", "s"), (6, "c", "en", "s")]
    index.deduplicate(make_docs(first), "one")
    second = make_docs([(1, "a b", "en", "s"), (2, "d", "en", "s")])
    for _ in range(2):  # a batch that runs again gives the same rows and adds nothing
        found = {r.doc_id: (r.keep_id, r.kept) for r in index.deduplicate(second, "two").collect()}
        assert found == {1: (5, False), 2: (2, True)}
        assert index.read().count() == 3


def test_kept_rows_keep_their_columns(make_docs, odd_rows):
    docs = make_docs(odd_rows, clashing=True)
    kept = exact_dedup.drop_exact_copies(docs, 4)
    assert kept.columns == docs.columns
    assert tidy(kept.select("doc_id").collect()) == tidy([(r[0],) for r in brute(odd_rows) if r[3]])


def test_empty_table(make_docs):
    assert exact_dedup.exact_dedup(make_docs([]), 4).count() == 0


def test_index_is_read_in_its_buckets(spark, make_docs):
    index = exact_dedup.DigestIndex.fresh(spark, 4)
    index.deduplicate(make_docs([(1, "x", "en", "s")]))
    probe = spark.range(10).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))
    plan = probe.join(index.read().hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1
