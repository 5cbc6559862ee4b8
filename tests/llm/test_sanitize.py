import hashlib
import random
import re
import time

import pytest

from siftlark.llm import pii, sanitize
from siftlark.llm.sanitize import Disclosure

# The patterns as the contract states them.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, text):
    digits = [int(c) for c in text if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def plain_spans(text):
    order = list(PLAIN)
    found = [(m.start(), order.index(k), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text) if holds(k, m[0])]
    return sorted(found)


def written(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)


@pytest.mark.parametrize("seed", range(6))
def test_same_spans_as_the_plain_patterns(seed):
    draw = random.Random(seed)
    pieces = ["a", "b.c", "@", ".", "-", "_", "+1 ", "+", "(49) ", "12", "0", "255", "4111 1111 1111 1111", "4111-1111", "1.2.3.4", "9", " ", "é", "x@y.z", "555-0101", "\n", "00000000000001", "300.1.1.1", "%"]
    for _ in range(3000):
        text = "".join(draw.choices(pieces, k=draw.randint(1, 14)))
        assert [tuple(s) for s in pii.base_spans(text)] == plain_spans(text), text


def test_examples():
    text = "Ask é.mia@x-1.example.org or +1 (499) 555-6503, card 4111 1111 1111 1111, host 010.0.0.255 not 1.2.3.256."
    found = [(pii.KINDS[s.kind], text[s.start : s.end]) for s in pii.base_spans(text)]
    assert found == [("email", ".mia@x-1.example.org"), ("phone", "+1 (499) 555-6503"), ("card", "4111 1111 1111 1111"), ("ip", "010.0.0.255")]
    assert pii.base_spans("4111 1111 1111 1112") == [] and pii.luhn("79927398713")


def test_long_texts_take_linear_time():
    began = time.perf_counter()
    for text in ("a" * 1_000_000, "1" * 1_000_000, "1." * 500_000, "+1" + "(" * 1_000_000, "a@" * 500_000, "a@b" + "-" * 1_000_000, "word " * 200_000, "x" * 999_999 + "@"):
        pii.base_spans(text)
        assert sum(len(p.terms) for p in pii.passages(text)) == len(re.findall(r"[^\W_]{4,}", text))
    assert time.perf_counter() - began < 10


def test_passages_cover_all_terms_in_order():
    draw = random.Random(3)
    for _ in range(300):
        text = "".join(draw.choices(["word ", "other", ". ", ".x", "\n", " ", "_", "Ünder"], k=draw.randint(0, 120)))
        found = list(pii.passages(text))
        assert [t for p in found for t in p.terms] == [m.span() for m in re.finditer(r"[^\W_]{4,}", text)]
        assert all(p.start <= p.terms[0][0] and p.terms[-1][1] <= p.end and len(p.terms) <= 32 for p in found)
        assert all(a.end <= b.start for a, b in zip(found, found[1:]))


def brute(rows, bits=1.0, support=3):
    """(doc_id, spans) of every row, with counts held in plain sets of passages."""
    with_entity, with_term, read = {}, {}, []
    for doc_id, text in rows:
        text = text or ""
        spans = plain_spans(text)
        free = lambda a, b: not any(a < e and s < b for s, _, e in spans)  # noqa: B023, E731
        terms = []
        for p in pii.passages(text):
            body = text[p.start : p.end]
            inside = {pii.entity(text, pii.Span(*s)) for s in spans if p.start <= s[0] < p.end}
            for a, b in p.terms:
                if free(a, b):
                    word = text[a:b].lower()
                    terms.append((word, a, b))
                    with_term.setdefault(word, set()).add(body)
                    for e in inside:
                        with_entity.setdefault((e, word), set()).add(body)
        read.append((doc_id, spans, terms))
    told = {w for (_, w), n in with_entity.items() if len(n) >= support and len(n) * 2**bits >= len(with_term[w])}
    return sorted(((i, written(sorted([*s, *((a, 4, b) for w, a, b in t if w in told)])), hashlib.sha256(written(s).encode()).hexdigest()) for i, s, t in read), key=repr)


def corpus(seed=1):
    draw = random.Random(seed)
    common = [f"word{chr(97 + i)}" for i in range(20)]
    people = {f"u{k}@mail.example.com": [f"Nick{k}name", f"town{k}ville"] for k in range(6)}
    rows = []
    for i in range(160):
        lines = []
        for _ in range(draw.randint(1, 4)):
            line = draw.choices(common, k=6)
            if draw.random() < 0.5:
                who = draw.choice(list(people))
                line += [draw.choice(people[who]), *([who] if draw.random() < 0.7 else [])]
                draw.shuffle(line)
            lines.append(" ".join(line))
        rows.append((i, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("slots", [sanitize.SLOTS, 32768])
@pytest.mark.parametrize("bits, support", [(1.0, 3), (0.0, 1), (0.25, 5)])
def test_same_as_brute_force(spark, slots, bits, support):
    rows = corpus()
    rows += [(1000 + i, rows[4][1]) for i in range(80)]  # copies add no evidence
    rows += [(None, "Nick1name town9ville 1.2.3.4"), (5, None), (5, None), (6, ""), (7, "nick1NAME only")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS start", "'x' AS term", "2 AS row_no", "3 AS n_term", "'y' AS spans").repartition(5)
    got = sanitize.find_private(docs, Disclosure(bits, support), slots).collect()
    assert sorted(((r.doc_id, r.spans, r.base_sha256) for r in got), key=repr) == brute(rows, bits, support)
    assert bits != 1.0 or any("term:" in r.spans for r in got)


def test_empty_tables_and_odd_rows(spark, make_docs, odd_rows):
    empty = sanitize.find_private(make_docs([]))
    assert empty.collect() == [] and empty.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_term", "base_sha256", "spans"]
    assert sanitize.sanitized(make_docs([])).collect() == []
    got = sanitize.find_private(make_docs(odd_rows, clashing=True)).collect()
    assert sorted(((r.doc_id, r.spans, r.base_sha256) for r in got), key=repr) == brute([(r[0], r[1]) for r in odd_rows])


def test_sanitized_texts(spark):
    alone = [f"w{'abcdefgh'[i]}{'abcdefgh'[j]}x seen" for i in range(8) for j in range(8)]
    rows = [(i, f"{w} mia@x.example.org Moonflower prefect{'abcd'[i % 4]} 70003 {'fill' * (i + 1)}.") for i, w in enumerate(alone[:8])]
    rows += [(100 + i, f"{w} prefab{i}xx 70{i:03d}") for i, w in enumerate(alone[8:40])] + [(300, "Call +1 (499) 555-6503 or x@y.zz"), (301, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in sanitize.sanitized(docs).collect()}
    # The nickname's first letters occur nowhere else: removed. The number's size is common: generalised.
    assert "Moonflower" not in got[0] and "[EMAIL]" in got[0] and "mia@" not in got[0] and "moo*" not in got[0]
    assert "70000" in got[0] and "70003" not in got[0]
    assert got[300] == "Call [PHONE] or [EMAIL]" and got[301] == ""
    assert got[100] == rows[8][1]
