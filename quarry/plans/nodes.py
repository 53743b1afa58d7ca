"""Plan nodes.  A plan can be run any number of times; nothing of a run is kept in it."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql.types import StructType

Unary = Callable[[Column], Column]
Binary = Callable[[Column, Column], Column]


class Node:
    """Any plan node."""

    def inputs(self) -> tuple[Node, ...]:
        return ()


@dataclass(frozen=True)
class GetTable(Node):
    """A table of the catalog."""

    name: str


@dataclass(frozen=True)
class CreateTable(Node):
    """Puts literal columns, by partition, into the catalog; a table of that name is replaced.

    ``partition_size`` is a hint for the number of Spark partitions.  A table without any partition needs a ``schema``.
    """

    name: str
    data: Mapping[int, Mapping[str, Sequence[Any]]] = field(hash=False)
    partition_size: int = 10_000
    schema: StructType | None = field(default=None, hash=False)


@dataclass(frozen=True)
class DropTable(Node):
    """Takes a name out of the catalog, if it is there; has no result."""

    name: str


@dataclass(frozen=True)
class InsertRow(Node):
    """Appends one row by position: to the catalog's table if the input is ``GetTable``, else to a copy of the result."""

    table: Node
    row: Sequence[Any] = field(hash=False)

    def inputs(self) -> tuple[Node, ...]:
        return (self.table,)


@dataclass(frozen=True)
class Scan(Node):
    """The rows where ``predicate`` holds for one column."""

    input: Node
    column: str
    predicate: Unary

    def inputs(self) -> tuple[Node, ...]:
        return (self.input,)


@dataclass(frozen=True)
class Projection(Node):
    """The named columns in that order; none gives no rows either."""

    input: Node
    columns: Sequence[str] = field(hash=False)

    def inputs(self) -> tuple[Node, ...]:
        return (self.input,)


@dataclass(frozen=True)
class _Join(Node):
    left: Node
    right: Node
    left_column: str
    right_column: str

    def inputs(self) -> tuple[Node, ...]:
        return (self.left, self.right)


@dataclass(frozen=True)
class NestedLoopJoin(_Join):
    """Inner join by any condition on one column of each side.

    Columns of one name on both sides need ``suffixes``.  ``strategy`` forces a join hint.
    """

    predicate: Binary
    suffixes: tuple[str, str] | None = None
    strategy: str | None = None


@dataclass(frozen=True)
class HashJoin(_Join):
    """Inner equi-join; a ``predicate`` is equality, or refused."""

    predicate: Binary | None = None
    suffixes: tuple[str, str] | None = None
    strategy: str | None = None


@dataclass(frozen=True)
class HashBucketJoin(_Join):
    """Inner join by any condition among rows whose columns have the same remainder by ``buckets``."""

    predicate: Binary
    buckets: int = 50
    suffixes: tuple[str, str] | None = None
    strategy: str | None = None
