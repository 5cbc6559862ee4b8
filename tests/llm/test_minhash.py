import random

from siftlark.llm import components, minhash
from siftlark.llm.shingles import exact_set
from tests.llm.conftest import words


def brute(rows, size, percent=80):
    sets = {}
    for i, t, *_ in rows:
        sets[i] = exact_set(t or "", size)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = [i for i in sets if i is not None and sets[i]]
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), None if i is None else find(i)) for i in sets}


def check(make_docs, rows, size):
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(make_docs(rows, clashing=True), words=size).collect()}
    assert found == brute(rows, size)


def test_matches_all_pairs_on_odd_rows(make_docs, odd_rows):
    check(make_docs, odd_rows, 2)


def test_groups_of_near_copies_and_chains(make_docs):
    """Stars around an original and chains of small steps, whose ends are far apart."""
    draw, rows = random.Random(5), []
    for group in range(4):
        base = words(900 + group, 120)
        for copy in range(12):
            text = list(base)
            for at in draw.sample(range(120), 5):
                text[at] = f"new{draw.random()}"
            rows.append((len(rows), " ".join(text), "en", "s"))
    chain = words(990, 100)
    for step in range(8):
        chain = chain[6:] + words(2000 + step, 6)
        rows.append((len(rows), " ".join(chain), "en", "s"))
    draw.shuffle(rows)
    check(make_docs, rows, 2)


def test_kept_rows_keep_their_columns(make_docs, odd_rows):
    docs = make_docs(odd_rows, clashing=True)
    kept = minhash.drop_near_copies(docs, words=2)
    assert kept.columns == docs.columns
    whole = brute(odd_rows, 2)
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, c) in whole.items() if c == i}


def test_empty_table(make_docs):
    assert minhash.near_duplicates(make_docs([])).count() == 0


def test_components_of_paths_and_hubs(spark):
    path = [(i, i + 1) for i in range(40)]
    hub = [(500, 500 + i) for i in range(1, 60)] + [(400, 520)]
    edges = spark.createDataFrame(path + hub + [(7, 7)], "a long, b long")
    found = {r.node: r.label for r in components.components(edges).collect()}
    assert found == {**{i: 0 for i in range(1, 41)}, **{500 + i: 400 for i in range(60)}}
    later = components.components(spark.createDataFrame([(40, 599 - 40)], "a long, b long"), spark.createDataFrame(list(found.items()), "node long, label long"))
    assert {r.label for r in later.collect()} == {0}


def test_texts_that_share_an_id_keep_their_links(make_docs):
    """Both texts of id 1 have a near copy of their own."""
    a, b = words(71, 60), words(72, 60)
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join([*a, "z"])), (3, " ".join([*b, "z"])), (4, " ".join(words(73, 60)))]
    found = [(r.doc_id, r.component_id) for r in minhash.near_duplicates(make_docs([(i, t, "en", "s") for i, t in rows])).collect()]
    assert sorted(found) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]


def test_a_group_at_all_distances(make_docs):
    """Copies from nearly equal to a similarity of 0.5 of one text: some are linked with others only."""
    draw, rows = random.Random(8), []
    base = words(700, 150)
    for copy in range(160):
        text = list(base)
        for at in draw.sample(range(150), draw.randint(2, 24)):
            text[at] = f"new{draw.randint(0, 400)}"
        rows.append((copy, " ".join(text), "en", "s"))
    check(make_docs, rows, 2)
    check(make_docs, rows, 5)


def test_texts_that_use_the_same_words_are_no_pairs(spark, make_docs, monkeypatch):
    """Twice the unlinked texts from one small vocabulary do not make four times the pairs of the last round."""
    made = {}
    keep = minhash.materialize

    def counted(frame, label):
        out = keep(frame, label)
        made[label] = made.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(minhash, "materialize", counted)
    draw = random.Random(4)
    vocabulary, weights = words(40, 150), [1 / k for k in range(1, 151)]
    texts = [" ".join(draw.choices(vocabulary, weights, k=90)) for _ in range(1200)]
    pairs = []
    for n in (600, 1200):
        made.clear()
        found = minhash.near_duplicates(make_docs([(i, t, "en", "s") for i, t in enumerate(texts[:n])]), words=2)
        assert found.where("kept").count() == n
        pairs.append((made["change_posts"], made["leader_pairs"], made["pairs"]))
    assert pairs[1][0] < 1200 and pairs[1][1] < 12_000, pairs


def test_bands_lose_no_pair_with_enough_matches():
    for coordinates, matches, width in ((64, 35, 2), (64, 44, 3), (9, 6, 2), (8, 3, 1)):
        needed = minhash.bands_shared(coordinates, matches, width)
        bands, rest = divmod(coordinates, width)
        # The worst case: every band is one match short, and the coordinates beyond the bands all match.
        spread = rest + bands * (width - 1)
        assert needed == matches - spread and needed > 0


def test_rare_shingles_lose_no_link_and_leave_out_what_a_group_shares(spark):
    """Sets around one original, half of them in one component: every link between components is met, and few other pairs."""
    draw, sets = random.Random(3), {}
    for node in range(240):
        size = 100 + node % 7
        kept = draw.sample(range(size), size - draw.choice([4, 8, 14, 30]))
        sets[node] = {*kept, *(draw.randint(1000, 1400) if node % 5 else 10_000 + node * 100 + k for k in range(size - len(kept)))}
    part = {node: 0 if node < 120 else node for node in sets}
    rows = [(node, part[node], len(s), e) for node, s in sets.items() for e in s]
    posts = minhash.rare_shingles(spark.createDataFrame(rows, "node long, part long, size long, element long"), 80)
    met = [tuple(sorted((r.a, r.b))) for r in minhash.rare_pairs(posts, 80).collect()]
    assert all(part[a] != part[b] for a, b in met)
    linked = {(a, b) for a in sets for b in sets if a < b and part[a] != part[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert linked and linked <= set(met)
    far = {n for n, s in sets.items() if n % 5 == 0 and len(s & set(range(107))) < 80}
    assert far and not any(a in far or b in far for a, b in met)


def test_wide_bands_lose_less_than_they_may():
    width = minhash.band_width(minhash.COORDINATES, minhash.MATCHES, minhash.PERCENT)
    assert width == 4 and (1 - 0.8**width) ** (minhash.COORDINATES // width) <= minhash.LOSS
    # Too few coordinates for wide bands: only such as are sure to be shared.
    assert minhash.band_width(64, 35, 80) == 2 and minhash.band_width(8, 3, 80) == 1
