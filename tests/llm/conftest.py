import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Columns whose names the operators use inside must not disturb them.
CLASHING = "digest string, row_no long, label string, score double, shard long, key string, rep long, host string, n_rows long"


def words(seed: int, n: int) -> list[str]:
    draw = random.Random(seed)
    return ["".join(draw.choices("abcdefgh", k=draw.randint(2, 7))) for _ in range(n)]


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows, clashing=False):
        full = [(i, t, g, s, None if t is None else len(t)) for i, t, g, s in rows]
        df = spark.createDataFrame(full, SCHEMA)
        if clashing:
            for field in CLASHING.split(", "):
                name, kind = field.split(" ")
                df = df.selectExpr("*", f"CAST(7 AS {kind}) AS {name}")
        return df

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, repeated rows, ties, exact and near copies, a very long text."""
    base = words(1, 60)
    near = base[:30] + ["changed"] + base[31:]
    rows = [
        (1, " ".join(base), "en", "a"),
        (2, "  ".join(base) + "\t", "en", "a"),
        (3, " ".join(near), "en", "b"),
        (4, None, "de", None),
        (5, "", None, "b"),
        (6, " \n\t ", "fr", "b"),
        (7, "one", "en", "c"),
        (8, "One", "en", "c"),
        (9, " ".join(words(2, 6000)), "en", "c"),
        (10, "you are\nyou are\nyou are fine | # $ ok", "en", "c"),
        (10, "you are\nyou are\nyou are fine | # $ ok", "en", "c"),
        (None, "no id here", "en", "c"),
        (12, " ".join(words(3, 80)), "es", "a"),
    ]
    rows += [(100 + i, " ".join(words(50 + i % 7, 30 + i % 7)), "en", "hot") for i in range(30)]
    return rows
