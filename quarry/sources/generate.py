"""Synthetic tables of uniform integers, made by the tasks themselves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEED = 100


def chunk_sizes(rows: int, partition_size: int) -> list[int]:
    """Full partitions, and what is left in the last."""
    full, rest = divmod(rows, partition_size)
    return [partition_size] * full + [rest] * (rest > 0)


def uniform(spark: SparkSession, columns: Sequence[str], rows: int, partition_size: int, distinct: int, seed: int = SEED) -> DataFrame:
    """``rows`` rows, every column drawn from 0 to ``distinct`` - 1; the same for the same arguments."""
    n = max(1, len(chunk_sizes(rows, partition_size)))
    draw = (F.floor(F.rand(seed + i) * distinct).cast("int").alias(c) for i, c in enumerate(columns))
    return spark.range(0, rows, 1, n).select(*draw)
