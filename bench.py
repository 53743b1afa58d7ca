"""Times the plan queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one line of JSON.

A result is forced by the ``noop`` sink: every row is made and none is sent to the driver.  Each query runs
``REPEATS`` times after one run to warm up, and its median counts; the metric is the sum of the medians.
"""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

from pyspark.sql import SparkSession

from quarry import Engine
from quarry.plans import GetTable, HashJoin, NestedLoopJoin, Scan
from quarry.queries import QUERIES
from quarry.sources import generate

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = 3
HEADLINE = ("scan_lt", "scan_chain", "scan_project", "hash_join", "hash_join_scans", "hash_join_twice", "hash_bucket_join_lt", "nlj_lt", "hash_buckets")


def synthetic(spark: SparkSession):
    """Joins and scans of generated integers: the right side has a tenth of the left's rows."""
    engine = Engine(spark)
    for name, rows, size in (("l", 1_000_000, 125_000), ("r", 100_000, 12_500), ("ls", 20_000, 2_500), ("rs", 2_000, 250)):
        df = generate.uniform(spark, [f"{name}{i}" for i in (1, 2)], rows, size, max(rows // 10, 1)).cache()
        df.count()
        engine.register(name, df)
    yield "synthetic_hash_join", lambda: engine.query(HashJoin(GetTable("l"), GetTable("r"), "l1", "r1"))
    yield "synthetic_nested_loop_join", lambda: engine.query(NestedLoopJoin(GetTable("ls"), GetTable("rs"), "ls1", "rs1", lambda a, b: a < b))
    yield "synthetic_scan", lambda: engine.query(Scan(GetTable("l"), "l1", lambda c: c < 55))


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    jobs = [(name, lambda name=name: QUERIES[name](spark, SF_DIR)) for name in HEADLINE]
    took = {}
    for name, job in [*jobs, *synthetic(spark)]:
        times = []
        for _ in range(REPEATS + 1):
            began = time.perf_counter()
            job().write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(median(times[1:]), 4)
        print(name, took[name], file=sys.stderr)
    sf = os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "sum of medians, plan queries", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
