"""Every engine query that SQL can express, held against DuckDB on the smallest tables."""

import math
from pathlib import Path

import pytest

from siftlark.plans import all_queries as registry

TABLES = Path("/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    connection = duckdb.connect()
    for file in TABLES.iterdir():
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 7) + 0.0
    return value.isoformat() if hasattr(value, "isoformat") else value


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, duck, name):
    found = registry.QUERIES[name](spark, str(TABLES))
    names = sorted(found.columns)
    told = duck.execute(registry.ORACLES[name])
    heads = [d[0] for d in told.description]
    assert sorted(heads) == names
    at = [heads.index(n) for n in names]
    expected = sorted(repr([plain(row[i]) for i in at]) for row in told.fetchall())
    assert sorted(repr([plain(row[n]) for n in names]) for row in found.collect()) == expected
