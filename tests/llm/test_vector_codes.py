import hashlib
import math

import numpy as np
import pytest

from siftlark.llm import vector_codes
from siftlark.llm.vector_codes import VaFile

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, size, entries=256):
    """Codes of (vec_id, vector, label) rows by distances to all entries, in Python's integers."""
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], g) for i, v, g in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = lambda v: [v[p * size // 4 : (p + 1) * size // 4] for p in range(4)]
    books = [[cut(v)[p] for _, v, _ in kept[:entries]] for p in range(4)]

    def nearest(book, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry)), e) for e, entry in enumerate(book))

    for _ in range(4):
        for p, book in enumerate(books):
            held = {}
            for _, v, _ in kept:
                held.setdefault(nearest(book, cut(v)[p])[1], []).append(cut(v)[p])
            books[p] = [[sum(c) // len(held[e]) for c in zip(*held[e])] if e in held else entry for e, entry in enumerate(book)]
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    found = [(i, g, [nearest(books[p], part) for p, part in enumerate(cut(v))]) for i, v, g in kept]
    errors = {}
    for _, g, near in found:
        errors[g] = errors.get(g, 0) + sum(d for d, _ in near)
    return sorted(((i, "".join(f"{e:02x}" for _, e in near), sum(d for d, _ in near), errors[g], digest) for i, g, near in found), key=repr)


def coded(df):
    names = ("vec_id", "code", "error", "label_error", "codebooks_sha256")
    return sorted((tuple(r[n] for n in names) for r in vector_codes.compress_vectors(df).collect()), key=repr)


@pytest.mark.parametrize("seed, spread, bits", [(0, 3, 4), (1, 400, 4), (2, 1 << 24, 2), (3, 1, 1), (4, 50, 6)])
def test_va_file_is_exact(seed, spread, bits):
    draw = np.random.default_rng(seed)
    entries, parts = draw.integers(-spread, spread, (int(draw.integers(1, 257)), 7)), draw.integers(-spread, spread, (1200, 7))
    file = VaFile(entries, bits)
    gaps = ((parts[:, None, :] - entries[None]) ** 2).sum(axis=2)
    lower, upper = file.bounds(parts)
    assert (lower.T <= gaps).all() and (upper.T >= gaps).all()
    index, error = file.nearest(parts)
    assert (index == gaps.argmin(axis=1)).all() and (error == gaps.min(axis=1)).all()


def test_bounds_leave_few_candidates():
    draw = np.random.default_rng(9)
    entries, parts = draw.normal(0, 150, (256, 16)).astype(np.int64), draw.normal(0, 150, (500, 16)).astype(np.int64)
    lower, upper = VaFile(entries).bounds(parts)
    assert (lower <= upper.min(axis=0)).mean() < 0.2


def random_rows(seed, n, size=8, scale=0.2):
    draw = np.random.default_rng(seed)
    return [(int(i), [float(x) for x in draw.normal(0, scale, size).astype(np.float32)], int(draw.integers(0, 4))) for i in range(n)]


def test_same_as_brute_force(spark):
    rows = random_rows(1, 300)
    rows += [(500 + i, rows[7][1], 2) for i in range(150)]  # a group of copies with a third of all rows
    assert coded(spark.createDataFrame(rows, SCHEMA).repartition(5)) == brute(rows, 8)


def test_odd_rows(spark):
    rows = random_rows(2, 40)
    rows += [
        (40, None, 1), (41, [], 1), (42, [0.1] * 7 + [None], 1), (43, [float("nan")] * 8, 1), (44, [float("-inf")] + [0.0] * 7, 1),
        (45, [0.5] * 4, 1), (46, [0.5] * 12, None), (None, [0.25] * 8, None), (3, rows[3][1], None), (3, [-0.125] * 8, 0), (47, [-0.0, 0.0] * 4, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS v", "7 AS n", "'y' AS code", "0L AS label_key", "1 AS part")
    assert coded(df) == brute(rows, 8)
    assert {r[0] for r in coded(df)} >= {None, 3, 47} and not {r[0] for r in coded(df)} & {40, 41, 42, 43, 44, 45, 46}


def test_empty_tables_and_large_magnitudes(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert coded(empty) == [] and coded(spark.createDataFrame([(1, None, 1), (2, [1.0, 2.0, 3.0], 1)], SCHEMA)) == []
    with pytest.raises(ValueError, match="too large"):
        vector_codes.compress_vectors(spark.createDataFrame([(1, [1e30] * 8, 1)], SCHEMA))
    with pytest.raises(ValueError, match="two hex digits"):
        vector_codes.compress_vectors(empty, entries=300)
