import os

import pytest

from quarry import Engine
from quarry.plans import GetTable, HashJoin, Projection, Scan
from quarry.sources import files, generate
from quarry.streaming import parquet_stream

SF = "/root/testdata/sf0.001"


def test_generated(spark):
    assert generate.chunk_sizes(11, 4) == [4, 4, 3]
    assert generate.chunk_sizes(3, 3) == [3]
    assert generate.chunk_sizes(20, 5) == [5, 5, 5, 5]
    for columns, rows, size in ((["a", "b"], 11, 4), (["a"], 3, 3), (["a"], 20, 5)):
        df = generate.uniform(spark, columns, rows, size, 10)
        assert df.columns == columns and df.count() == rows
        assert df.rdd.getNumPartitions() == len(generate.chunk_sizes(rows, size))
        assert all(0 <= v < 10 for r in df.collect() for v in r)
        assert df.collect() == generate.uniform(spark, columns, rows, size, 10).collect()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pushdown_and_pruning(spark):
    engine = Engine(spark)
    for t in ("lineitem", "orders"):
        engine.register(t, files.parquet(spark, SF, t))
    plan = Projection(Scan(Scan(GetTable("lineitem"), "l_partkey", lambda c: c < 3), "l_suppkey", lambda c: c == 2), ["l_orderkey"])
    text = engine.query(plan)._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(l_partkey,3)" in text and "EqualTo(l_suppkey,2)" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_suppkey:bigint>" in text
    text = engine.query(HashJoin(GetTable("lineitem"), GetTable("orders"), "l_orderkey", "o_orderkey"))._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in text and "NestedLoop" not in text


def test_stream(spark, tmp_path):
    spark.range(10).selectExpr("cast(id as int) a").write.parquet(str(tmp_path / "in"))
    engine = Engine(spark)
    engine.register("s", parquet_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema))
    found = engine.query(Projection(Scan(GetTable("s"), "a", lambda c: c > 6), ["a"]))
    assert found.isStreaming
    query = found.writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(r.a for r in spark.table("found").collect()) == [7, 8, 9]
