import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from siftlark.llm import quality


def counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {p for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_counts_match_brute_force(make_docs, odd_rows):
    found = quality.quality_verdicts(make_docs(odd_rows, clashing=True)).collect()
    assert sorted((str(r.doc_id), *(r[n] for n in NAMES)) for r in found) == sorted((str(i), *counts(t)) for i, t, *_ in odd_rows)
    assert not any(r.kept for r in found if r.base_failed)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c", "\n", "#", "é"]), max_size=40), min_size=1, max_size=12))
def test_repeated_windows_of_random_texts(make_docs, texts):
    rows = [(i, " ".join(t), "en", "s") for i, t in enumerate(texts)]
    found = {
        r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.text_counts(make_docs(rows)).collect()}
    assert found == {i: counts(t)[:5] for i, t, *_ in rows}


def test_posterior_rejects_junk_and_keeps_clean(make_docs):
    from tests.llm.conftest import words

    clean = [(i, " ".join(w + (" the" if k % 4 == 0 else "") for k, w in enumerate(words(i, 80))), "en", "s") for i in range(60)]
    junk = [(1000 + i, " ".join(w + "###" for w in words(500 + i, 80)), "en", "s") for i in range(8)]
    found = {r.doc_id: r.kept for r in quality.quality_verdicts(make_docs(clean + junk)).collect()}
    assert all(found[i] for i, *_ in clean) and not any(found[i] for i, *_ in junk)


def test_em_recovers_rates_of_generated_votes(spark):
    import random

    draw = random.Random(3)
    rows = []
    for _ in range(4000):
        bad = draw.random() < 0.2
        rows.append(tuple(0 if draw.random() < (0.6 if bad else 0.01) else 1 for _ in quality.RULES))
    votes = spark.createDataFrame(rows, [r.name for r in quality.RULES])
    model = quality.fit(votes, steps=30)
    assert abs(model.bad_share - 0.2) < 0.04 and all(abs(h - 0.6) < 0.1 for h in model.hit) and all(f < 0.03 for f in model.false_hit)


def test_empty_table(make_docs):
    assert quality.quality_verdicts(make_docs([])).count() == 0
