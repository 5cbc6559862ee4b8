from siftlark.llm import mixing
from tests.llm.conftest import words

MARGINS = (mixing.Margin("source", {"hot": 0.25, "a": 0.25, "b": 0.25, "c": 0.25}), mixing.Margin("lang", {"en": 0.6, "de": 0.4}))


def rows(n):
    """One source with a third of all rows."""
    return [(i, " ".join(words(i, 40)), "en" if i % 5 else "de", "hot" if i % 3 == 0 else "abc"[i % 7 % 3]) for i in range(n)]


def test_margins_meet_their_targets(make_docs):
    docs = rows(600)
    cells = make_docs(docs).groupBy("source", "lang").agg({"n_chars": "sum"}).withColumnRenamed("sum(n_chars)", "tokens")
    raked = mixing.rake(cells, MARGINS, budget=0.3).collect()
    total = sum(r.weight for r in raked)
    assert abs(total / sum(r.tokens for r in raked) - 0.3) < 1e-6 and all(0 <= r.weight <= r.tokens for r in raked)
    for column, shares in (("source", MARGINS[0].shares), ("lang", MARGINS[1].shares)):
        for name, share in shares.items():
            assert abs(sum(r.weight for r in raked if r[column] == name) / total - share) < 1e-3


def test_sample_meets_budget_and_is_stable(make_docs):
    docs = make_docs(rows(2000), clashing=True)
    found = mixing.mix(docs, budget=0.4).collect()
    assert len(found) == 2000 and all(0 <= r.probability <= 1 for r in found)
    total, taken = sum(r.n_tokens for r in found), sum(r.n_tokens for r in found if r.sampled)
    assert abs(taken / total - 0.4) < 0.05
    again = mixing.sample_documents(docs, budget=0.4)
    assert again.columns == docs.columns
    assert {r.doc_id for r in again.collect()} == {r.doc_id for r in found if r.sampled}
    more = {r.doc_id for r in mixing.mix(docs, budget=0.7).where("sampled").collect()}
    assert len(more) > taken / 40


def test_odd_rows(make_docs, odd_rows):
    found = mixing.mix(make_docs(odd_rows, clashing=True)).collect()
    assert len(found) == len(odd_rows)
    assert {r.source for r in found if r.doc_id == 4} == {"(none)"} and {r.lang for r in found if r.doc_id == 5} == {"(none)"}
    assert mixing.mix(make_docs([])).count() == 0


def test_the_drawn_sample_meets_feasible_targets(make_docs):
    """Shares of the drawn tokens, not only of the weights; German holds too little for its target and is taken whole."""
    docs = [(i, " ".join(words(i, 20 + i % 60)), "de" if i % 20 == 0 else "en", "hot" if i % 3 == 0 else "abc"[i % 7 % 3]) for i in range(3000)]
    report = {(r.margin, r.category): r for r in mixing.margins_report(mixing.mix(make_docs(docs), MARGINS, 0.4), MARGINS, 0.4).collect()}
    assert [k for k, r in report.items() if not r.feasible] == [("lang", "de")]
    short = report["lang", "de"]
    assert abs(short.sampled - short.available) < 1e-9
    # English makes up for it: the budget is spent, and the sources have their targets.
    assert abs(sum(r.sampled for k, r in report.items() if k[0] == "lang") - 1) < 0.01 and all(r.met for r in report.values())
    assert abs(report["lang", "en"].aim - (1 - short.available)) < 1e-9
    for name in MARGINS[0].shares:
        assert abs(report["source", name].sampled - 0.25) < 0.01
    feasible = [(i, t, "de" if i % 5 < 2 else "en", s) for i, t, _, s in docs]
    report = mixing.margins_report(mixing.mix(make_docs(feasible), MARGINS, 0.4), MARGINS, 0.4).collect()
    assert all(r.feasible and abs(r.sampled - r.target) < 0.01 for r in report)


def test_raking_by_joins_gives_the_same_weights(make_docs, monkeypatch):
    cells = make_docs(rows(300)).groupBy("source", "lang").agg({"n_chars": "sum"}).withColumnRenamed("sum(n_chars)", "tokens")
    weights = lambda: {(r.source, r.lang): r.weight for r in mixing.rake(cells, MARGINS, sweeps=5, budget=0.5).collect()}
    here = weights()
    monkeypatch.setattr(mixing, "LOCAL_CELLS", 0)
    there = weights()
    assert here.keys() == there.keys() and all(abs(here[k] - there[k]) < 1e-6 for k in here)


def test_raking_leaves_its_input_alone(make_docs):
    cells = make_docs(rows(200)).groupBy("source", "lang").agg({"n_chars": "sum"}).withColumnRenamed("sum(n_chars)", "tokens")
    columns = list(cells.columns)
    once, twice = (sorted(map(tuple, mixing.rake(cells, MARGINS, budget=0.4).collect())) for _ in range(2))
    assert once == twice and cells.columns == columns and len(cells.schema) == 3


def test_aims_fill_up_to_the_budget(spark):
    held = {"a": 5, "b": 10, "c": 100, "d": 1000, "e": 0}
    cells = spark.createDataFrame(list(held.items()), "source string, tokens long")
    margin = mixing.Margin("source", {"a": 0.3, "b": 0.3, "c": 0.2, "d": 0.1, "e": 0.1})
    for goal in (5.0, 40.0, 200.0, 900.0, 1115.0, 2000.0):
        found = {r.source: r.aim for r in mixing.aims(cells, margin, goal).collect()}
        assert abs(sum(found.values()) - min(goal, 1115)) < 1e-6
        levels = {found[k] / t for k, t in margin.shares.items() if found[k] < held[k] - 1e-9}
        assert not levels or max(levels) - min(levels) < 1e-6 and all(held[k] <= t * max(levels) + 1e-6 for k, t in margin.shares.items() if found[k] >= held[k] - 1e-9)


def test_rows_without_an_id_draw_by_their_text(make_docs):
    docs = make_docs([(None if i % 2 else i, " ".join(words(i, 40)), "en", "a") for i in range(1500)])
    found = mixing.mix(docs, budget=0.4).collect()
    lost = [r.sampled for r in found if r.doc_id is None]
    assert len(lost) == 750 and 0.3 * 750 < sum(lost) < 0.5 * 750
    kept = mixing.sample_documents(docs, budget=0.4).collect()
    assert sum(r.doc_id is None for r in kept) == sum(lost) and len(kept) == sum(r.sampled for r in found)
