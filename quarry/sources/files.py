"""Tables from Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``folder/name.parquet``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
