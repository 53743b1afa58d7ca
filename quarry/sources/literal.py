"""Tables from literal columns, given by partition."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import ArityMismatch, NoSchema

MOST_PARTITIONS = 200


def table(spark: SparkSession, data: Mapping[int, Mapping[str, Sequence[Any]]], partition_size: int = 10_000, schema: T.StructType | None = None) -> DataFrame:
    """Non-null integers, unless a schema says otherwise; the columns keep the order of the first partition."""
    if partition_size < 1:
        raise ValueError("partition_size must be positive")
    if not data and schema is None:
        raise NoSchema("a table without partitions needs a schema")
    names = schema.names if schema else list(data[min(data)])
    rows: list[tuple] = []
    for k in sorted(data):
        if set(data[k]) != set(names):
            raise ArityMismatch(f"partition {k} has the columns {sorted(data[k])}, not {sorted(names)}")
        columns = [data[k][n] for n in names]
        if len({len(c) for c in columns}) > 1:
            raise ArityMismatch(f"the columns of partition {k} have different lengths")
        rows += zip(*columns, strict=True)
    kind = schema or T.StructType([T.StructField(n, T.IntegerType(), False) for n in names])
    df = spark.createDataFrame(rows, kind)
    return df.coalesce(max(1, min(MOST_PARTITIONS, -(-len(rows) // partition_size))))
