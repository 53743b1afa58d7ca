"""Named tables.  A table is a DataFrame and the rows inserted since, which the driver holds; what was fetched before an insert doesn't change."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .errors import ArityMismatch, NoSharedFolder, TableNotFound

#: Used where the session names no folder, and only on a local master: the executors of a cluster could not reach it.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def checkpoints(spark: SparkSession) -> str:
    """The checkpoint folder: the one that the session names or has, or one of this machine if all runs on it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise NoSharedFolder("set spark.checkpoint.dir to a folder that all executors can reach")
        spark.sparkContext.setCheckpointDir(LOCAL_CHECKPOINTS)
    return spark.sparkContext.getCheckpointDir()


def one_row(width: int, row: Sequence[Any]) -> tuple:
    if len(row) != width:
        raise ArityMismatch(f"a row of {len(row)} values for {width} columns")
    return tuple(row)


def with_rows(df: DataFrame, rows: list[tuple]) -> DataFrame:
    """``df`` and literal rows, in its schema."""
    return df.union(df.sparkSession.createDataFrame(rows, df.schema)) if rows else df


@dataclass
class _Table:
    base: DataFrame
    inserted: list[tuple] = field(default_factory=list)

    @cached_property
    def width(self) -> int:
        return len(self.base.columns)


class Snapshot:
    """A table as it was after an insert.  It is a DataFrame from its first use on, so rows that are inserted one by one cost nothing until then."""

    def __init__(self, table: _Table):
        self._table, self._n, self._frame = table, len(table.inserted), None

    def frame(self) -> DataFrame:
        if self._frame is None:
            self._frame = with_rows(self._table.base, self._table.inserted[: self._n])
        return self._frame

    def __getattr__(self, name: str) -> Any:
        return getattr(self.frame(), name)

    def __getitem__(self, item: Any) -> Any:
        return self.frame()[item]


class Catalog:
    def __init__(self):
        self._tables: dict[str, _Table] = {}

    def put(self, name: str, df: DataFrame) -> None:
        """Registers; a table of that name is replaced."""
        self._tables[name] = _Table(df)

    def _find(self, name: str) -> _Table:
        if name not in self._tables:
            raise TableNotFound(name)
        return self._tables[name]

    def fetch(self, name: str) -> DataFrame:
        """The table as it is now."""
        return Snapshot(self._find(name)).frame()

    def insert(self, name: str, row: Sequence[Any]) -> Snapshot:
        table = self._find(name)
        table.inserted.append(one_row(table.width, row))
        return Snapshot(table)

    def drop(self, name: str) -> None:
        self._tables.pop(name, None)

    def names(self) -> list[str]:
        return sorted(self._tables)

    def clear(self) -> None:
        self._tables.clear()
