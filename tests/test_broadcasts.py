"""No side of a join goes through the driver by the size of its files: only counted ones are broadcast."""

import pytest
from pyspark.sql import functions as F

from siftlark.operators import fulltext, retrieval
from siftlark.operators import matching as M
from siftlark.plans import run_queries
from tests.test_match_run import small_run

HASHED = "BroadcastHashJoin"


def planned(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def written(monkeypatch):
    """The plans of all that is written, before it runs."""
    plans = {}
    keep = M.stored

    def noted(frame, label):
        plans.setdefault(label, planned(frame))
        return keep(frame, label)

    for module in (M, fulltext, run_queries):
        monkeypatch.setattr(module, "stored", noted)
    return plans


def test_stages_of_a_run_merge_what_nobody_counted(spark, written):
    # All of these tables are far below the size at which Spark broadcasts on its own.
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").removesuffix("b")) >= 1 << 20
    runs, terms, catalogue, embedded = small_run(spark)
    candidates, stages = M.run_matches(runs, terms, catalogue, embedded, F.lit(True))
    for label in ("lexical", "semantic", "fused", "reranked"):
        assert HASHED not in written[label], label
    assert written["started"].count(HASHED) <= 2  # instants, which are counted, and one row for each range of them
    assert HASHED not in planned(candidates) and HASHED not in planned(stages)
    assert candidates.count() == 48 and {r.mode for r in stages.collect()} == {"hybrid"}


def test_queries_of_runs_broadcast_counted_sides_only(spark, written):
    for name in ("q9_match_run", "f17_score_components"):
        written.clear()
        frame = getattr(run_queries, name)(spark, "/root/testdata/sf0.001")
        assert HASHED not in planned(frame), name
        assert not [label for label in ("lexical", "semantic", "fused", "reranked", "asked_criteria", "evaluated_rules") if HASHED in written.get(label, "")], name


def test_id_lists_are_those_of_one_run(spark, written, monkeypatch):
    searched = []
    search = M.lexical_candidates
    monkeypatch.setattr(M, "lexical_candidates", lambda *given: searched.append(given) or search(*given))
    frame = run_queries.q10_id_lists(spark, "/root/testdata/sf0.001")
    assert len(searched) == 1 and HASHED not in planned(frame) and "MapInArrow" not in planned(frame)


def test_sides_over_the_bound_are_merged(spark, monkeypatch):
    left, right = spark.range(9), spark.range(5)
    assert HASHED in planned(left.join(M.bounded(right), "id"))
    assert HASHED not in planned(left.join(M.bounded(right, 3), "id"))
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", 3)
    assert HASHED not in planned(left.join(fulltext._small(right), "id"))
