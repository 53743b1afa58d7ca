"""Connected components of links between integers, by alternating large and small stars.

Every round is a few joins and aggregations over the links that are left, written to the shared
folder; nothing goes to the driver but two numbers that tell whether the links still change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are linked to its smallest."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component``, the smallest node it is linked to, for every node that has a smaller one.

    Links may repeat, and link a node with itself.  The number of rounds grows with the logarithm of the
    longest chain.
    """
    folder = shared_dir(links.sparkSession)
    edges = stored(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a != b").distinct(), "links", folder)
    sign, n = None, 0
    while True:
        n += 1
        edges = stored(_small_star(_large_star(edges)), f"round-{n}", folder)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == sign:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        sign = now
