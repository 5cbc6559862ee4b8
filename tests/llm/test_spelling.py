import random
import re
import zlib
from collections import Counter

import pytest

from siftlark.llm import spelling, trie

from .conftest import SCHEMA


def distance_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_counts(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 7:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= 2}


def brute_variants(counts):
    rows = {}
    for w, n in counts.items():
        near = [v for v in counts if distance_one(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        form = best if best is not None and counts[best] >= 10 * n else None
        rows[w] = (form, n, len(near), None if form is None else counts[form])
    found = set()
    for w, (form, n, n_near, form_n) in rows.items():
        root = w
        while rows[root][0] is not None:
            root = rows[root][0]
        found.add((w, form, root, n, n_near, form_n))
    return found


def random_words(seed, n, letters="abéÿ", least=1, most=9):
    draw = random.Random(seed)
    return sorted({"".join(draw.choices(letters, k=draw.randint(least, most))) for _ in range(n)})


@pytest.mark.parametrize("seed", range(4))
def test_trie_finds_what_all_pairs_find(seed):
    words = random_words(seed, 300, "ab" if seed % 2 else "abc")
    held = trie.unpacked(trie.build(words, list(range(1, len(words) + 1))).packed())
    for asked in [*words, "", "a", "zzz", "abababababababab"]:
        found = list(trie.neighbours(held, asked))
        assert sorted(found) == [(w, i + 1) for i, w in enumerate(words) if distance_one(asked, w)]


def test_trie_of_very_long_words_is_shallow():
    long = "ab" * 50_000
    words = sorted([long, long + "a", long[:-1], "x" + long])
    held = trie.build(words, [1] * 4)
    assert len(held.labels) <= 2 * len(words) + 1
    assert sorted(w for w, _ in trie.neighbours(held, long)) == sorted([long + "a", long[:-1], "x" + long])


def sampled_texts(seed=5):
    draw = random.Random(seed)
    base = ["".join(draw.choices("abcdeé", k=draw.randint(6, 9))) for _ in range(25)]
    rows = []
    for i in range(60):
        words = draw.choices(base, weights=[2**-(k // 3) for k in range(25)], k=40)
        words = [w if draw.random() > 0.1 else w[: len(w) // 2] + draw.choice("abx") + w[len(w) // 2 + 1 :] for w in words]
        rows.append((i, " ".join(w.title() if draw.random() < 0.2 else w for w in words) + "!?1Ünder_score"))
    return rows


@pytest.mark.parametrize("shard_words, round_bytes", [(200_000, 32 << 20), (7, 1), (5, 400)])
def test_same_as_brute_force(spark, shard_words, round_bytes):
    rows = sampled_texts() + [(None, "Straßenbahn straßenbahn STRASSENBAHN"), (None, None), (7, ""), (7, "Straßenbahn Straßenbahm")]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], SCHEMA)
    counts = spelling.word_counts(docs)
    expected = brute_counts(rows)
    assert {(r.word, r.n) for r in counts.collect()} == set(expected.items())
    found = spelling.spelling_variants(counts, shard_words=shard_words, round_bytes=round_bytes)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == brute_variants(expected)
    assert any(r[1] for r in got)


def test_chains_end_at_their_root(spark):
    counts = {"aaaaaaa": 1000, "aaaaaab": 100, "aaaaacb": 10, "aaaadcb": 1, "aaaaaaaa": 1000, "zzzzzzz": 3, "aaaaaaz": 100}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {tuple(r) for r in spelling.spelling_variants(words).collect()}
    assert got == brute_variants(counts)
    roots = {r[0]: r[2] for r in got}
    assert roots["aaaadcb"] == "aaaaaaa" and roots["zzzzzzz"] == "zzzzzzz"
    # Ties: of two neighbours with 1000 the smaller one in code-point order.
    assert {r[0]: r[1] for r in got}["aaaaaab"] == "aaaaaaa"


def test_odd_rows_and_clashing_names(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows, clashing=True).selectExpr("*", "'x' AS word", "3 AS n", "'y' AS form")
    got = {tuple(r) for r in spelling.spelling_variants(spelling.word_counts(docs)).collect()}
    assert got == brute_variants(brute_counts([(r[0], r[1]) for r in odd_rows]))
    empty = make_docs([])
    assert spelling.spelling_variants(spelling.word_counts(empty)).collect() == []
    assert spelling.spelling_variants(spelling.word_counts(empty)).columns == ["word", "form", "root", "n", "n_near", "form_n"]
