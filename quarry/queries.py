"""Registered queries of the plan API, and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .engine import Engine
from .operators import rowids
from .plans import CreateTable, DropTable, GetTable, HashBucketJoin, HashJoin, InsertRow, NestedLoopJoin, Node, Projection, Scan, opaque
from .sources import files, generate

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return files.parquet(spark, folder, name)


def _tables(node: Node) -> set[str]:
    own = {node.name} if isinstance(node, GetTable) else set()
    return own.union(*map(_tables, node.inputs()))


def _plan(name: str, plan: Node, sql: str) -> None:
    """A plan over Parquet tables."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        engine = Engine(spark)
        for t in sorted(_tables(plan)):
            engine.register(t, _table(spark, folder, t))
        return engine.query(plan)

    QUERIES[name], ORACLES[name] = run, sql


def _frame(name: str, run: Query, sql: str) -> None:
    QUERIES[name], ORACLES[name] = run, sql


def _equal(a, b):
    return a == b


nation, region, orders, lineitem, customer, supplier = map(GetTable, ("nation", "region", "orders", "lineitem", "customer", "supplier"))

_plan("get_table", nation, "SELECT * FROM nation")
_plan("scan_true", Scan(region, "r_regionkey", lambda c: True), "SELECT * FROM region WHERE TRUE")
_plan("scan_eq", Scan(orders, "o_custkey", lambda c: c == 7), "SELECT * FROM orders WHERE o_custkey = 7")
_plan("scan_lt", Scan(lineitem, "l_partkey", lambda c: c < 55), "SELECT * FROM lineitem WHERE l_partkey < 55")
_plan("scan_opaque", Scan(lineitem, "l_partkey", opaque(lambda v: v < 55)), "SELECT * FROM lineitem WHERE l_partkey < 55")
_plan(
    "scan_chain", Scan(Scan(lineitem, "l_linenumber", lambda c: c == 1), "l_suppkey", lambda c: c == 2),
    "SELECT * FROM lineitem WHERE l_linenumber = 1 AND l_suppkey = 2",
)
_plan("scan_empty", Scan(lineitem, "l_linenumber", lambda c: c < 0), "SELECT * FROM lineitem WHERE l_linenumber < 0")
_plan("project_one", Projection(nation, ["n_regionkey"]), "SELECT n_regionkey FROM nation")
_plan("project_many", Projection(orders, ["o_orderkey", "o_custkey"]), "SELECT o_orderkey, o_custkey FROM orders")
_plan("scan_project", Projection(Scan(lineitem, "l_partkey", lambda c: c < 55), ["l_orderkey"]), "SELECT l_orderkey FROM lineitem WHERE l_partkey < 55")

_NATION_REGION = "SELECT n_nationkey, n_name, n_regionkey, r_regionkey, r_name FROM nation JOIN region ON n_regionkey {} r_regionkey"
_plan("nlj_equi", NestedLoopJoin(nation, region, "n_regionkey", "r_regionkey", _equal), _NATION_REGION.format("="))
_plan("nlj_lt", NestedLoopJoin(nation, region, "n_regionkey", "r_regionkey", lambda a, b: a < b), _NATION_REGION.format("<"))
_plan("hash_join", HashJoin(lineitem, orders, "l_orderkey", "o_orderkey"), "SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
FLAGSHIP = HashJoin(Scan(lineitem, "l_partkey", lambda c: c < 55), Scan(orders, "o_custkey", lambda c: c < 55), "l_orderkey", "o_orderkey", _equal)
_plan(
    "hash_join_scans", FLAGSHIP,
    "SELECT * FROM (SELECT * FROM lineitem WHERE l_partkey < 55) l JOIN (SELECT * FROM orders WHERE o_custkey < 55) o ON l_orderkey = o_orderkey",
)
_plan(
    "hash_join_no_match", HashJoin(nation, Scan(region, "r_regionkey", lambda c: c < 0), "n_regionkey", "r_regionkey"),
    "SELECT * FROM nation JOIN (SELECT * FROM region WHERE r_regionkey < 0) r ON n_regionkey = r_regionkey",
)
_plan(
    "hash_join_twice", HashJoin(HashJoin(lineitem, orders, "l_orderkey", "o_orderkey"), customer, "o_custkey", "c_custkey"),
    "SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey",
)
_plan(
    "hash_bucket_join_lt", HashBucketJoin(customer, supplier, "c_custkey", "s_suppkey", lambda a, b: a < b),
    "SELECT * FROM customer JOIN supplier ON c_custkey % 50 = s_suppkey % 50 AND c_custkey < s_suppkey",
)
_plan(
    "self_join", Projection(HashJoin(nation, nation, "n_regionkey", "n_nationkey", suffixes=("_l", "_r")), ["n_nationkey_l", "n_name_l", "n_nationkey_r", "n_name_r"]),
    "SELECT a.n_nationkey AS n_nationkey_l, a.n_name AS n_name_l, b.n_nationkey AS n_nationkey_r, b.n_name AS n_name_r FROM nation a JOIN nation b ON a.n_regionkey = b.n_nationkey",
)


def _insert_row(spark: SparkSession, folder: str) -> DataFrame:
    engine = Engine(spark)
    kind = T.StructType([T.StructField("n_nationkey", T.IntegerType()), T.StructField("n_regionkey", T.IntegerType())])
    engine.register("source", _table(spark, folder, "nation"))
    engine.query(CreateTable("added", {}, schema=kind))
    engine.query(InsertRow(GetTable("added"), (100, 7)))
    return engine.query(Projection(GetTable("source"), ["n_nationkey", "n_regionkey"])).union(engine.query(GetTable("added")))


_frame("insert_row", _insert_row, "SELECT n_nationkey, n_regionkey FROM nation UNION ALL SELECT 100, 7")
_frame(
    "row_ids", lambda spark, d: rowids.filter_row_ids(_table(spark, d, "orders"), "o_custkey", lambda c: c == 7, "o_orderkey"),
    "SELECT rid FROM (SELECT CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS rid, o_custkey FROM orders) t WHERE o_custkey = 7",
)
_frame(
    "gather", lambda spark, d: rowids.gather(_table(spark, d, "nation"), "n_name", [3, 0, 3], "n_nationkey", positions=True),
    "SELECT CAST(pos AS BIGINT) AS pos, n_name FROM (VALUES (0, 3), (1, 0), (2, 3)) ids(pos, id) JOIN (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS rid, n_name FROM nation) t ON rid = id",
)
_frame(
    "gather_all", lambda spark, d: rowids.gather(_table(spark, d, "orders"), "o_custkey", None, "o_orderkey", positions=True),
    "SELECT CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS pos, o_custkey FROM orders",
)
_frame(
    "gather_optional", lambda spark, d: rowids.gather_optional(_table(spark, d, "nation"), "n_name", [1, 3], "n_nationkey"),
    "SELECT CAST(rid AS BIGINT) AS rid, CASE WHEN rid IN (1, 3) THEN n_name END AS n_name FROM (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS rid, n_name FROM nation) t",
)
_frame(
    "hash_buckets", lambda spark, d: rowids.hash_buckets(_table(spark, d, "lineitem"), "l_partkey"),
    "SELECT l_partkey % 50 AS hash_key, count(*) AS n FROM lineitem GROUP BY l_partkey % 50",
)
_frame(
    "hash_entries", lambda spark, d: rowids.hash_entries(_table(spark, d, "orders"), "o_custkey", "o_orderkey"),
    "SELECT o_custkey % 50 AS hash_key, CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS row_id, o_custkey AS value FROM orders",
)
_frame(
    "probe_indices", lambda spark, d: rowids.probe_indices(_table(spark, d, "nation"), _table(spark, d, "region"), "n_regionkey", "r_regionkey", "n_nationkey", "r_regionkey"),
    "SELECT CAST(l.rid AS BIGINT) AS left_row, CAST(r.rid AS BIGINT) AS right_row FROM (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS rid, n_regionkey FROM nation) l JOIN (SELECT row_number() OVER (ORDER BY r_regionkey) - 1 AS rid, r_regionkey FROM region) r ON l.n_regionkey = r.r_regionkey",
)
_frame("column_size", lambda spark, d: rowids.column_size(_table(spark, d, "lineitem"), "l_orderkey"), "SELECT count(*) AS size FROM lineitem")
_frame(
    "partitions", lambda spark, d: rowids.partitions(generate.uniform(spark, ["a"], 1000, 300, 50)),
    "SELECT CAST(range AS INTEGER) AS partition, CAST(250 AS BIGINT) AS n FROM range(4)",
)
_frame(
    "generated", lambda spark, d: generate.uniform(spark, ["a", "b"], 1000, 300, 50).selectExpr("count(*) AS n", "min(a) >= 0 AND max(a) < 50 AND min(b) >= 0 AND max(b) < 50 AS within"),
    "SELECT CAST(1000 AS BIGINT) AS n, TRUE AS within",
)


def _named(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "name string")


def _engine(spark: SparkSession, folder: str) -> Engine:
    engine = Engine(spark)
    for name in ("nation", "region"):
        engine.register(name, _table(spark, folder, name))
    return engine


def _drop_table(spark: SparkSession, folder: str) -> DataFrame:
    engine = _engine(spark, folder)
    engine.query(DropTable("region"))
    return _named(spark, engine.list_tables())


def _insert_rows(spark: SparkSession, folder: str) -> DataFrame:
    engine = _engine(spark, folder)
    before = engine.query(GetTable("region"))
    for k in range(3):
        engine.query(InsertRow(GetTable("region"), (100 + k, f"new {k}")))
    return engine.query(GetTable("region")).exceptAll(before)


def _materialize(spark: SparkSession, folder: str) -> DataFrame:
    engine = _engine(spark, folder)
    columns = engine.materialize(engine.query(Projection(GetTable("nation"), ["n_nationkey", "n_name"])))
    return spark.createDataFrame(list(zip(*columns.values(), strict=True)), "n_nationkey int, n_name string")


_DATA = {0: {"a": [1, 2], "b": [3, 4]}, 1: {"a": [5, 2], "b": [7, 4]}}
_frame("create_table", lambda spark, d: Engine(spark).query(CreateTable("t", _DATA)), "SELECT * FROM (VALUES (1, 3), (2, 4), (5, 7), (2, 4)) t(a, b)")
_frame("drop_table", _drop_table, "SELECT 'nation' AS name")
_frame("list_tables", lambda spark, d: _named(spark, _engine(spark, d).list_tables()), "SELECT * FROM (VALUES ('nation'), ('region')) t(name)")
_frame("list_columns", lambda spark, d: _named(spark, _table(spark, d, "orders").columns), "SELECT column_name AS name FROM (DESCRIBE orders)")
_frame("insert_rows", _insert_rows, "SELECT * FROM (VALUES (100, 'new 0'), (101, 'new 1'), (102, 'new 2')) t(r_regionkey, r_name)")
_frame("materialize", _materialize, "SELECT n_nationkey, n_name FROM nation")


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return QUERIES["hash_join_scans"](spark, folder)
