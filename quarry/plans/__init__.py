"""Logical plans: immutable nodes, the predicates in them, and their compilation to DataFrames."""

from .nodes import CreateTable, DropTable, GetTable, HashBucketJoin, HashJoin, InsertRow, NestedLoopJoin, Node, Projection, Scan
from .predicates import opaque

__all__ = [
    "CreateTable", "DropTable", "GetTable", "HashBucketJoin", "HashJoin", "InsertRow", "NestedLoopJoin", "Node", "Projection", "Scan", "opaque",
]
