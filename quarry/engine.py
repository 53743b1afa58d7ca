"""The client: runs plans against a catalog and brings results to the driver."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .catalog import Catalog
from .plans.compiler import compile_plan
from .plans.nodes import Node


class Engine:
    """``Engine()`` makes a session of its own and stops it on shutdown; ``Engine(spark)`` leaves it to its owner."""

    def __init__(self, spark: SparkSession | None = None):
        self._owned = spark is None
        self.spark = spark or SparkSession.builder.appName("quarry").getOrCreate()
        self.catalog = Catalog()

    def register(self, name: str, df: DataFrame) -> None:
        """Makes any DataFrame a table."""
        self.catalog.put(name, df)

    def query(self, plan: Node) -> DataFrame | None:
        """Effects happen now, once; the result is lazy, and shows the tables as they are now."""
        return compile_plan(self.spark, self.catalog, plan)

    def materialize(self, df: DataFrame) -> dict[str, list[Any]]:
        """The columns as lists; what is at one place in them is of one row."""
        rows = df.collect()
        return {name: [row[i] for row in rows] for i, name in enumerate(df.columns)}

    def list_tables(self) -> list[str]:
        return self.catalog.names()

    def shutdown(self) -> None:
        self.catalog.clear()
        if self._owned:
            self.spark.stop()
