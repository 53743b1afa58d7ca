"""Plans over literal tables; results are compared as multisets of rows."""

import time
from collections import Counter

import pytest

from quarry.errors import ArityMismatch, ColumnCollision, ColumnNotFound, NoSchema, NotAnEquiJoin, TableNotFound
from quarry.plans import CreateTable, DropTable, GetTable, HashBucketJoin, HashJoin, InsertRow, NestedLoopJoin, Projection, Scan, opaque
from quarry.plans.predicates import is_equality


def rows(df):
    return Counter(map(tuple, df.collect()))


def made(engine, name, *partitions, size=10):
    engine.query(CreateTable(name, dict(enumerate(partitions)), size))
    return GetTable(name)


def equal(a, b):
    return a == b


JOINS = [lambda *a, **k: NestedLoopJoin(*a, equal, **k), lambda *a, **k: HashJoin(*a, **k), lambda *a, **k: HashJoin(*a, equal, **k), lambda *a, **k: HashBucketJoin(*a, equal, **k)]


@pytest.mark.parametrize(
    ("parts", "column", "predicate", "expected"),
    [
        ([{"a": [1, 2, 3], "b": [1, 2, 3]}], "a", lambda c: True, [(1, 1), (2, 2), (3, 3)]),
        ([{"a": [1, 2], "b": [1, 2]}, {"a": [3, 4], "b": [3, 4]}], "a", lambda c: c == 1, [(1, 1)]),
        ([{"a": [2, 3], "b": [4, 5]}], "a", lambda c: c == 2, [(2, 4)]),
        ([{"a": [3, 5, 10], "b": [4, 9, 6]}, {"a": [1, 7, 3], "b": [8, 4, 3]}, {"a": [6, 4, 9], "b": [7, 2, 8]}], "a", lambda c: c == 3, [(3, 4), (3, 3)]),
        ([{"a": [1, 2], "b": [1, 2]}], "a", lambda c: c > 9, []),
        ([{"a": [1, 2], "b": [1, 2]}], "a", opaque(lambda v: v % 2 == 0), [(2, 2)]),
    ],
)
def test_scan(engine, parts, column, predicate, expected):
    result = engine.query(Scan(made(engine, "t", *parts), column, predicate))
    assert result.columns == ["a", "b"]
    assert rows(result) == Counter(expected)


def test_scan_chain_and_projection(engine):
    t = made(engine, "t", {"a": [1, 1], "b": [2, 2]})
    assert rows(engine.query(Scan(Scan(t, "a", lambda c: c == 1), "b", lambda c: c == 2))) == Counter({(1, 2): 2})
    t = made(engine, "t", {"a": [1, 2], "b": [1, 2]}, {"a": [3, 4], "b": [3, 4]})
    assert rows(engine.query(Projection(Scan(t, "a", lambda c: c == 2), ["a"]))) == Counter([(2,)])


@pytest.mark.parametrize("names", [["a"], ["b", "a"], ["a", "b"]])
def test_projection(engine, names):
    t = made(engine, "t", {"a": [1, 2, 3], "b": [4, 5, 6]}, {"a": [7], "b": [8]})
    assert engine.query(Projection(t, names)).columns == names
    assert rows(engine.query(Projection(t, ["a"]))) == Counter([(1,), (2,), (3,), (7,)])


def test_projection_of_nothing(engine):
    t = made(engine, "t", {"a": [1], "b": [1]})
    none = engine.query(Projection(t, []))
    assert none.columns == [] and none.count() == 0
    assert engine.query(Projection(Scan(t, "a", lambda c: c < 0), ["b"])).count() == 0
    with pytest.raises(ColumnCollision):
        engine.query(Projection(t, ["a", "a"]))


@pytest.mark.parametrize("join", JOINS)
@pytest.mark.parametrize(
    ("left", "right", "expected"),
    [
        ([[1, 2]], [[2, 3]], [(2, 2)]),
        ([[1, 2], [3, 4]], [[2, 3], [4, 5]], [(2, 2), (3, 3), (4, 4)]),
        ([[1, 2, 3], [4]], [[2, 3], [4, 5]], [(2, 2), (3, 3), (4, 4)]),
        ([[1, 2]], [[3, 4]], []),
        ([[1]], [[51]], []),
        ([[-7, 43, 7]], [[-7, 7]], [(-7, -7), (7, 7)]),
        ([[]], [[1]], []),
        ([[1]], [[]], []),
        ([[1]], [[1], [2], [1]], [(1, 1), (1, 1)]),
        ([[5, 5]], [[5, 5, 5]], [(5, 5)] * 6),
    ],
)
def test_equi_joins(engine, join, left, right, expected):
    l, r = made(engine, "l", *({"a": x} for x in left)), made(engine, "r", *({"b": x} for x in right))
    result = engine.query(join(l, r, "a", "b"))
    assert result.columns == ["a", "b"]
    assert rows(result) == Counter(expected)


def test_join_keeps_all_columns(engine):
    l, r = made(engine, "l", {"a": [1, 2], "a2": [4, 5]}), made(engine, "r", {"b": [2, 3], "b2": [5, 6]})
    for join in JOINS:
        assert rows(engine.query(join(l, r, "a", "b"))) == Counter([(2, 5, 2, 5)])


def test_theta_joins(engine):
    l, r = made(engine, "l", {"a": [1, 2, 3]}), made(engine, "r", {"b": [2, 3]})
    assert rows(engine.query(NestedLoopJoin(l, r, "a", "b", lambda a, b: a < b))) == Counter([(1, 2), (1, 3), (2, 3)])
    assert engine.query(NestedLoopJoin(l, r, "a", "b", lambda a, b: True)).count() == 6
    l, r = made(engine, "l", {"a": [1, 2]}), made(engine, "r", {"b": [51, 3, 102]})
    assert rows(engine.query(HashBucketJoin(l, r, "a", "b", lambda a, b: a < b))) == Counter([(1, 51), (2, 102)])
    with pytest.raises(NotAnEquiJoin):
        engine.query(HashJoin(l, r, "a", "b", lambda a, b: a < b))


def test_self_join_and_collisions(engine):
    t = made(engine, "t", {"a": [1, 2], "b": [2, 1]})
    with pytest.raises(ColumnCollision):
        engine.query(HashJoin(t, t, "a", "b"))
    for join in JOINS:
        result = engine.query(join(t, t, "a", "b", suffixes=("_l", "_r")))
        assert result.columns == ["a_l", "b_l", "a_r", "b_r"]
        assert rows(result) == Counter([(1, 2, 2, 1), (2, 1, 1, 2)])
    other = made(engine, "o", {"a": [1], "c": [9]})
    assert engine.query(HashJoin(t, other, "a", "a", suffixes=("", "2"))).columns == ["a", "b", "a2", "c"]


def test_two_hash_joins(engine):
    a, b, c = made(engine, "x", {"a": [1, 2]}), made(engine, "y", {"b": [1, 2]}), made(engine, "z", {"c": [2, 3]})
    assert rows(engine.query(HashJoin(HashJoin(a, b, "a", "b"), c, "b", "c"))) == Counter([(2, 2, 2)])


@pytest.mark.parametrize(("strategy", "operator"), [("shuffle_hash", "ShuffledHashJoin"), ("merge", "SortMergeJoin"), ("broadcast", "BroadcastHashJoin")])
def test_strategies(engine, strategy, operator):
    l, r = made(engine, "l", {"a": [1]}), made(engine, "r", {"b": [1]})
    df = engine.query(HashJoin(l, r, "a", "b", strategy=strategy))
    assert operator in df._jdf.queryExecution().executedPlan().toString()


def test_errors(engine):
    t = made(engine, "t", {"a": [1]})
    with pytest.raises(TableNotFound):
        engine.query(GetTable("no"))
    for plan in (Scan(t, "no", equal), Projection(t, ["no"]), HashJoin(t, t, "a", "no", suffixes=("l", "r"))):
        with pytest.raises(ColumnNotFound):
            engine.query(plan)
    with pytest.raises(TypeError, match="&"):
        engine.query(Scan(t, "a", lambda c: c > 0 and c < 5))
    with pytest.raises(TypeError):
        engine.query(Scan(t, "a", lambda c: 1))
    with pytest.raises(TypeError):
        engine.query(Scan(DropTable("t"), "a", lambda c: True))


def test_create(engine):
    t = made(engine, "t", {"a": [], "b": []})
    assert engine.query(t).columns == ["a", "b"]
    assert engine.materialize(engine.query(t)) == {"a": [], "b": []}
    names = ["f", "e", "d", "c", "b", "a"]
    assert engine.query(made(engine, "t", {n: [1] for n in names})).columns == names
    with pytest.raises(NoSchema):
        engine.query(CreateTable("t", {}))
    with pytest.raises(ArityMismatch):
        made(engine, "t", {"a": [1], "b": [1, 2]})
    with pytest.raises(ArityMismatch):
        made(engine, "t", {"a": [1]}, {"b": [1]})
    assert engine.list_tables() == ["t"]


def test_insert(engine):
    t = made(engine, "t", {"a": []}, size=2)
    for i in (1, 2, 3):
        assert engine.query(InsertRow(t, (i,))).count() == i
    t = made(engine, "t", {c: [] for c in "abcd"}, size=1)
    before = engine.query(t)
    for i in range(10):
        engine.query(InsertRow(t, (i,) * 4))
    assert rows(engine.query(t)) == Counter((i,) * 4 for i in range(10))
    assert before.count() == 0
    for bad in ((1,), (1, 2, 3, 4, 5)):
        with pytest.raises(ArityMismatch):
            engine.query(InsertRow(t, bad))
    assert engine.query(InsertRow(Scan(t, "a", lambda c: c < 2), (7,) * 4)).count() == 3
    assert engine.query(t).count() == 10


def test_catalog_and_materialize(engine):
    assert engine.list_tables() == []
    assert engine.query(DropTable("no")) is None
    t = made(engine, "t", {"a": [1, 2], "b": [2, 1]}, {"a": [3, 4], "b": [6, 7]}, {"a": [5, 6, 7], "b": [5, 4, 3]})
    found = engine.materialize(engine.query(t))
    assert sorted(zip(found["a"], found["b"], strict=True)) == [(1, 2), (2, 1), (3, 6), (4, 7), (5, 5), (6, 4), (7, 3)]
    assert made(engine, "t", {"z": [1]}) and engine.query(t).columns == ["z"]
    assert engine.query(DropTable("t")) is None and engine.list_tables() == []
    engine.shutdown()


def test_plans_can_run_again(engine):
    plan = Scan(CreateTable("t", {0: {"a": [1, 2]}}), "a", lambda c: c > 1)
    assert [engine.query(plan).count() for _ in range(2)] == [1, 1]


def test_equality_is_recognised():
    assert is_equality(lambda a, b: a == b) and is_equality(lambda a, b: b == a)
    for other in (lambda a, b: a < b, lambda a, b: a == 1, lambda a, b: a == a, lambda a, b: (a == b) & (a < b), lambda a, b: True, opaque(lambda a, b: a == b)):
        assert not is_equality(other)


def test_random_tables(engine):
    import random

    rng = random.Random(4)
    for n in range(4):
        l, r = ([rng.randint(-60, 60) for _ in range(rng.choice((0, 30)) + n)] for _ in "lr")
        a, b = made(engine, "l", {"a": l}), made(engine, "r", {"b": r})
        expected = Counter((x, y) for x in l for y in r if x == y)
        for join in JOINS:
            assert rows(engine.query(join(a, b, "a", "b"))) == expected


def test_many_inserts(engine, spark):
    """Rows inserted one by one cost nothing until the table is read, and earlier results stay as they are."""
    engine.register("t", spark.createDataFrame([(0, "a")], "k int, v string"))
    began = time.perf_counter()
    results = [engine.query(InsertRow(GetTable("t"), (k, "b"))) for k in range(1, 10_001)]
    assert time.perf_counter() - began < 10
    assert engine.query(GetTable("t")).count() == 10_001 and results[4].count() == 6 and results[0].columns == ["k", "v"]
    assert engine.query(Scan(InsertRow(GetTable("t"), (5, "c")), "k", lambda c: c == 5)).count() == 2


def test_nulls(engine, spark):
    """Null is equal to nothing in joins, and no predicate holds for it."""
    rows = [(1, "x"), (None, "y"), (2, None)]
    engine.register("l", spark.createDataFrame(rows, "a int, b string"))
    engine.register("r", spark.createDataFrame(rows, "c int, d string"))
    left, right = GetTable("l"), GetTable("r")
    assert engine.query(HashJoin(left, right, "a", "c")).count() == 2
    assert engine.query(NestedLoopJoin(left, right, "a", "c", lambda a, b: a <= b)).count() == 3
    assert engine.query(HashBucketJoin(left, right, "a", "c", lambda a, b: a == b)).count() == 2
    assert engine.query(Scan(left, "a", lambda c: c != 1)).count() == 1 and engine.query(Scan(left, "b", opaque(lambda v: v is not None and v < "z"))).count() == 2


def test_order_is_recognised():
    from quarry.plans.predicates import order

    assert order(lambda a, b: a < b) == order(lambda a, b: b >= a) == "lr" and order(lambda a, b: a >= b) == order(lambda a, b: b < a) == "rl"
    for other in (equal, lambda a, b: a < 1, lambda a, b: a < a, lambda a, b: (a < b) & (b < 9), lambda a, b: a + 1 < b, lambda a, b: True, opaque(lambda a, b: a < b)):
        assert order(other) is None


def within(a, b):
    return (a < b) & (b <= a + 100) | (a - b == 50)


def test_a_bucket_is_joined_in_many_tasks(engine, spark):
    """All rows are in one bucket and read by one task; no task makes most of the pairs, and each pair is made once."""
    from pyspark.sql import functions as F

    n = 9_000
    engine.register("l", spark.range(0, n, 1, 1).select((F.col("id") * 50).alias("a")))
    engine.register("r", spark.range(0, n, 1, 1).select((F.col("id") * 50).alias("b")))
    for predicate, expected in ((lambda a, b: a < b, n * (n - 1) // 2), (within, 3 * n - 4)):
        found = engine.query(HashBucketJoin(GetTable("l"), GetTable("r"), "a", "b", predicate))
        tasks = [r[1] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(tasks) == expected and max(tasks) < expected / 2
    for name, value in (("l", 7), ("r", 57)):  # one value
        engine.register(name, spark.range(0, n, 1, 1).select(F.lit(value).alias("a" if name == "l" else "b")))
    found = engine.query(HashBucketJoin(GetTable("l"), GetTable("r"), "a", "b", lambda a, b: a < b))
    tasks = [r[1] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == n * n and max(tasks) < n * n / 2


@pytest.mark.parametrize("predicate", [lambda a, b: a < b, lambda a, b: a <= b, lambda a, b: a > b, lambda a, b: b <= a, lambda a, b: (a < b) & (b < a + 150), lambda a, b: True, opaque(lambda a, b: a + b < 60)])
@pytest.mark.parametrize(("kind", "buckets"), [("int", 50), ("double", 1)])
def test_bucket_join_in_blocks(engine, spark, monkeypatch, predicate, kind, buckets):
    """The same rows as in one piece: values that many rows have, negative ones, nulls, equal rows and lone ends."""
    import random

    from quarry.operators import blocks

    rng = random.Random(7)
    kinds = {"a": kind, "b": "bigint" if kind == "int" else kind}
    for name, column, n in (("l", "a", 90), ("r", "b", 60)):
        values = [rng.choice((None, 7, 7, 57, -43, -93, rng.randint(-200, 200), 2**31 - 1 if name == "l" else -5000)) for _ in range(n)]
        engine.register(name, spark.createDataFrame([(None if v is None else v if kinds[column] != "double" else float(v), "same") for v in values], f"{column} {kinds[column]}, {name}2 string"))
    found = []
    for plain, block in ((1 << 60, 10), (0, 3)):
        monkeypatch.setattr(blocks, "PLAIN", plain)
        monkeypatch.setattr(blocks, "BLOCK", block)
        found.append(rows(engine.query(HashBucketJoin(GetTable("l"), GetTable("r"), "a", "b", predicate, buckets))))
    assert found[0] and found[1] == found[0]
