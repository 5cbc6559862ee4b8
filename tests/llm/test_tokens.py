import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siftlark.llm import packing, token_records
from siftlark.llm.tokens import END_ID, WordEncoder, tokenizer_path
from tests.llm.conftest import words

WHOLE = Tokenizer.from_file(tokenizer_path())
FAST = WordEncoder(tokenizer_path())


def ids_of(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids + [END_ID]


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(max_codepoint=0x17F), st.sampled_from(" \n\t́Σİﬁ \x1c語'st")), max_size=60))
def test_word_encoding_equals_whole_text_encoding(text):
    text += "<|endoftext|>" if len(text) % 5 == 0 else ""
    assert np.frombuffer(FAST.texts([text])[0], FAST.dtype).tolist() == ids_of(text)[:-1]


def expected(rows):
    out, start = [], 0
    for i, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = ids_of(t)
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_records_round_trip(make_docs, odd_rows):
    found = token_records.token_records(make_docs(odd_rows, clashing=True)).collect()
    assert sorted(map(tuple, found), key=str) == sorted(expected(odd_rows), key=str)
    assert token_records.token_records(make_docs([])).count() == 0


def test_single_records_by_offset_and_damage(spark, make_docs, odd_rows, tmp_path):
    rows = token_records.write_shards(make_docs(odd_rows[:6]), tmp_path.as_uri(), tokenizer_path()).collect()
    assert sum(r.n_records for r in rows) == 6
    path = rows[0].path
    offsets = token_records.read_offsets(path[:-4] + ".idx")
    last = token_records.read_record(path, int(offsets[-1]))
    assert last[-2:] == np.array([END_ID], "<u2").tobytes()
    file = tmp_path / path.rsplit("/", 1)[1]
    data = bytearray(file.read_bytes())
    data[15] ^= 1
    file.write_bytes(data)
    try:
        token_records.read_record(path, 0)
    except ValueError:
        return
    raise AssertionError("damage went unnoticed")


def check_pieces(rows, found, window):
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault(i, []).append(ids_of(t))
    used, filled = {}, {}
    for r in found:
        assert any(len(ids) == r.doc_tokens and zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for ids in texts[r.doc_id])
        used[r.doc_id] = used.get(r.doc_id, 0) + r.length
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert used == {i: sum(map(len, ids)) for i, ids in texts.items()}
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    return filled


def test_packing_covers_every_id_once(make_docs, odd_rows):
    for window, shard_docs in ((2048, 2000), (64, 7)):
        filled = check_pieces(odd_rows, packing.pack_documents(make_docs(odd_rows, clashing=True), window, shard_docs=shard_docs).collect(), window)
    open_windows = sum(sum(length for _, length in parts) < window for parts in filled.values())
    assert open_windows <= -(-len(odd_rows) // 7) + 1
    assert packing.pack_documents(make_docs([])).count() == 0


def test_neighbours_are_the_best_bm25_documents():
    ids = [np.array(x, dtype="<u2") for x in ([5, 6, 7, 8], [9, 10, 11, 12], [5, 6, 7, 13], [5, 20, 21, 22])]
    index = packing.ShardIndex(ids, np.ones(64), 4.0)
    brute = [sum(2.2 / 2.2 for t in set(ids[0].tolist()) & set(d.tolist())) for d in ids]
    assert np.allclose(index.scores(0), brute)
    pieces = list(packing.pack(ids, index, 8))
    assert [(d, s) for d, _, _, s, _ in pieces] == [(0, 0), (2, 0), (1, 1), (3, 1)]


def test_neighbours_come_from_the_whole_corpus(make_docs):
    """Fellows of a topic share a window, however many documents lie between them and however few are packed in the last go."""
    rows = [(50 * j + i, " ".join([f"topic{i}x"] * 2 + words(i, 6)), "en", "s") for i in range(12) for j in range(3)]
    window = 3 * max(len(ids_of(t)) for _, t, *_ in rows)
    for how in ({}, {"listed": 64}):
        found = packing.pack_documents(make_docs(rows), window, shard_docs=4, **how).collect()
        check_pieces(rows, found, window)
        windows, used = {}, set()
        for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
            windows.setdefault(r.sequence_id, []).append(r.doc_id)
        for docs in windows.values():
            topic = docs[0] % 50
            fellows = {50 * j + topic for j in range(3)} - used - {docs[0]}
            assert not fellows or len(docs) == 1 or docs[1] % 50 == topic
            used |= set(docs)


def test_every_term_of_the_seed_counts():
    seed = np.arange(2, 82, dtype="<u2")
    ids = [seed, np.concatenate([seed[:32], np.arange(100, 148)]).astype("<u2"), np.concatenate([seed[:20], seed[40:]]).astype("<u2")]
    index = packing.ShardIndex(ids, np.ones(200), 80.0)
    brute = [sum(2.2 / (1 + 1.2 * (0.25 + 0.75 * len(d) / 80)) for t in set(seed.tolist()) & set(d.tolist())) for d in ids]
    assert np.allclose(index.scores(0), brute) and index.scores(0)[2] > index.scores(0)[1]


def test_rows_of_one_id_are_spread_over_shards(spark, make_docs, tmp_path):
    """A third of all rows has no id, a third are copies of one row: no shard holds them all, and the ids' order is kept."""
    rows = [(None, f"lost {i}", "en", "a") for i in range(300)] + [(5, "the same row", "en", "a")] * 300 + [(10 + i, f"own {i}", "en", "a") for i in range(300)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        shards = token_records.write_shards(make_docs(rows).repartition(8), tmp_path.as_uri(), tokenizer_path()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(shards) > 2 and max(r.n_records for r in shards) < 500
    found = token_records.token_records(make_docs(rows)).collect()
    places = sorted(found, key=lambda r: r.start)
    assert len(found) == 900 and [p.start for p in places[1:]] == [p.start + p.n_tokens for p in places[:-1]]
    ids = [r.doc_id for r in places]
    known = [i for i in ids if i is not None]
    assert known == sorted(known) and ids.index(5) in (0, 300)


def by_hand(rows, window):
    """Packing by its rule, one seed at a time with scores of whole thousandths, in rounds of one seed; documents are shorter than a window."""
    docs = sorted(((i, ids_of(t)) for i, t, *_ in rows), key=lambda d: d[0])
    counted = [dict(zip(*(x.tolist() for x in np.unique(ids, return_counts=True)))) for _, ids in docs]
    n, mean = len(docs), sum(len(ids) for _, ids in docs) / len(docs)
    df = {t: sum(t in c for c in counted) for t in set().union(*counted) - {END_ID}}
    weight = [{t: round(np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(ids) / mean)) * 1000) for t, f in c.items() if t in df} for (_, ids), c in zip(docs, counted)]
    left, start, out, cut, sequence = [len(ids) for _, ids in docs], [0] * n, [], None, 0
    while any(left):
        seed = next(d for d in range(n) if left[d]) if cut is None else cut
        filled, cut = 0, None
        for doc in [seed, *sorted((d for d in range(n) if left[d] and d != seed), key=lambda d: (-sum(weight[d].get(t, 0) for t in counted[seed]), (d - seed) % n))]:
            take = min(left[doc], window - filled)
            out.append((docs[doc][0], start[doc], take, sequence, filled))
            start[doc], left[doc], filled = start[doc] + take, left[doc] - take, filled + take
            if filled == window:
                cut = doc if left[doc] else None
                break
        sequence += 1
    return out


def test_rounds_equal_packing_by_hand(make_docs, monkeypatch):
    """Many rounds of one seed, blocks and lists that end early give what one seed at a time gives, copies and ties included."""
    for name, value in (("SHORTEST", 2), ("FEWEST", 1), ("BLOCK", 3)):
        monkeypatch.setattr(packing, name, value)
    rows = [(i, " ".join(words(i % 9, 12) + words(900 + i % 3, 6) + ["same"] * (i % 3)), "en", "s") for i in range(14)]
    window = 3 * max(len(ids_of(t)) for _, t, *_ in rows) // 2
    found = packing.pack_documents(make_docs(rows), window, shard_docs=0, listed=1).collect()
    numbered = {q: k for k, q in enumerate(sorted({r.sequence_id for r in found}))}
    assert sorted((r.doc_id, r.start, r.length, numbered[r.sequence_id], r.offset) for r in found) == sorted(by_hand(rows, window))


def test_lists_end_where_a_task_may_hold_better_documents():
    """A task that kept its two best of three says nothing on what lies below them."""
    keys = [np.array([[90, 80]]), np.array([[70, 10]])]
    left = [np.array([[1, 2]], dtype=np.int32), np.array([[3, 4]], dtype=np.int32)]
    for dropped, expected in (([True, False], [90, 80]), ([False, True], [90, 80, 70, 10]), ([True, True], [90, 80]), ([False, False], [90, 80, 70, 10])):
        merged, _ = packing.merged_lists(keys, left, dropped, 9)
        assert [k for k in merged[0].tolist() if k > packing.NO_KEY] == expected


def test_sums_are_exact_also_where_single_precision_is_not():
    """Short and huge sums of whole thousandths: every score is the sum in whole numbers, and the lists keep its order."""
    draw = np.random.default_rng(1)
    for scale in (1.0, 4000.0):
        counted = [(np.sort(draw.choice(400, 150, replace=False)).astype("<u4"), draw.integers(1, 9, 150).astype("<u4")) for _ in range(40)]
        idf, slot = draw.random(400) * scale, np.full(400, -1)
        slot[::2] = np.arange(200)
        block = packing.Block(counted, np.full(40, 300.0), idf, 300.0, slot, 200)
        assert block.dtype == (np.float32 if scale == 1.0 else np.float64)
        query = np.sort(draw.choice(400, 120, replace=False))
        asked = np.zeros((1, 200), dtype=np.float32)
        asked[0, slot[query][slot[query] >= 0]] = 1.0
        whole = [sum(int(round(w)) for t, w in zip(terms.tolist(), packing.bm25(idf, terms.astype(int), n.astype(float), 300.0, 300.0) * 1000) if t in set(query.tolist())) for terms, n in counted]
        scores = block.scores(asked, [query[slot[query] < 0]])
        assert scores[0].astype(np.int64).tolist() == whole
        kept = packing.BestDocuments(np.array([7]), 40, 6)
        for at in (np.arange(0, 25), np.arange(25, 40)):
            kept.add(scores[:, at], at, np.ones(len(at), dtype=int))
        order = sorted(range(40), key=lambda d: (-whole[d], (d - 7) % 40))[:6]
        assert ((7 + (-kept.keys[0] & 0xFFFFFFFF)) % 40).tolist() == order
