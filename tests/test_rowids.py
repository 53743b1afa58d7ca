from collections import Counter

import pytest

from quarry.errors import ColumnNotFound
from quarry.operators import rowids


@pytest.fixture
def table(spark):
    return spark.createDataFrame([(i, v) for i, v in enumerate([1, 2, 1, 3])], "k int, v int").repartition(3)


def one(df):
    return [r[0] for r in df.collect()]


def test_row_ids(spark, table):
    assert {(r.k, r.rid) for r in rowids.with_row_ids(table, "k").collect()} == {(i, i) for i in range(4)}
    many = spark.range(5000).selectExpr("id % 7 as a", "id as b").repartition(9)
    expected = sorted((r.a, r.b) for r in many.collect())
    assert [(r.a, r.b) for r in rowids.with_row_ids(many, "a").orderBy("rid").collect()] == expected
    assert rowids.with_row_ids(table.limit(0), "k").count() == 0


def test_filter(table):
    assert one(rowids.filter_row_ids(table, "v", lambda c: c == 1, "k")) == [0, 2]
    assert one(rowids.filter_row_ids(table, "v", lambda c: c == 3, "k")) == [3]
    assert one(rowids.filter_row_ids(table, "v", lambda c: True, "k")) == [0, 1, 2, 3]
    with pytest.raises(ColumnNotFound):
        rowids.filter_row_ids(table, "no", lambda c: True, "k")


def test_gather(table):
    assert one(rowids.gather(table, "v", [0, 1], "k")) == [1, 2]
    assert one(rowids.gather(table, "v", [3, 0, 3], "k")) == [3, 1, 3]
    assert one(rowids.gather(table, "v", None, "k")) == [1, 2, 1, 3]
    assert one(rowids.gather(table, "v", [], "k")) == []


def test_gather_optional(table):
    assert [r.v for r in rowids.gather_optional(table, "v", [0, 1], "k").orderBy("rid").collect()] == [1, 2, None, None]
    assert [(r.k, r.v) for r in rowids.gather_optional(table, ["k", "v"], [1, 3, 3], "k").orderBy("rid").collect()] == [(None, None), (1, 2), (None, None), (3, 3)]


def test_buckets(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1, 2, 2, 3, 51, -7])], "k int, v int")
    assert {tuple(r) for r in rowids.hash_buckets(df, "v").collect()} == {(1, 2), (2, 2), (3, 1), (-7, 1)}
    assert {tuple(r) for r in rowids.hash_entries(df, "v", "k").collect()} == {(1, 0, 1), (2, 1, 2), (2, 2, 2), (3, 3, 3), (1, 4, 51), (-7, 5, -7)}
    assert rowids.column_size(df, "v").first().size == 6


def test_probe(spark):
    left = spark.createDataFrame([(0, 5), (1, 5), (2, 4)], "k int, v int")
    right = spark.createDataFrame([(0, 4), (1, 5), (2, 7)], "k int, v int")
    assert Counter(map(tuple, rowids.probe_indices(left, right, "v", "v", "k", "k").collect())) == Counter([(0, 1), (1, 1), (2, 0)])


def test_columns_of_any_name(spark):
    """Columns may have the names that are used inside."""
    names = ["id", "task", "before", "rid", "pos", "value_", "c0", "k0", "at", "a b"]
    df = spark.createDataFrame([tuple(range(i, i + len(names))) for i in range(4)], names)
    for n in names:
        assert one(rowids.gather(df, n, [3, 0, 3], names[-1])) == [names.index(n) + k for k in (3, 0, 3)]
        assert [r[1] for r in sorted(map(tuple, rowids.gather_optional(df, n, [1], "id").collect()))] == [None, names.index(n) + 1, None, None]
        assert one(rowids.filter_row_ids(df, n, lambda c, n=n: c == names.index(n) + 2, "rid")) == [2]
    assert rowids.with_row_ids(df, "task", "rid_").columns == [*names, "rid_"]
    assert {tuple(r) for r in rowids.hash_entries(df, "rid", "id").collect()} == {(3 + i, i, 3 + i) for i in range(4)}
    assert {tuple(r) for r in rowids.probe_indices(df, df, "task", "id", "id", "pos").collect()} == {(i, i + 1) for i in range(3)}


def test_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, 2), (1, 5)], "k int, v int")
    rows = rowids.with_row_ids(df, "k").collect()
    assert sorted(r.rid for r in rows) == [0, 1, 2, 3] and [r.rid for r in rows if r.k is None] == [0]
    assert rowids.filter_row_ids(df, "v", lambda c: c > 1, "k").count() == 2 and rowids.column_size(df, "v").first().size == 4
    assert sorted(map(tuple, rowids.gather(df, "v", [0, 9], "k", positions=True).collect())) == [(0, 2)]


def test_partitions(spark):
    assert {tuple(r) for r in rowids.partitions(spark.range(0, 10, 1, 2)).collect()} == {(0, 5), (1, 5)}
