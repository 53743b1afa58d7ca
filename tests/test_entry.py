"""Every query with SQL agrees with DuckDB on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from quarry.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return db


def test_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) == set(QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    found = Counter(repr(tuple(r[n] for n in names)) for r in df.collect())
    result = duck.execute(ORACLES[name])
    at = {d[0]: i for i, d in enumerate(result.description)}
    assert sorted(at) == names
    assert found == Counter(repr(tuple(r[at[n]] for n in names)) for r in result.fetchall())
