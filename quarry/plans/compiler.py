"""Plans to DataFrames.  Effects on the catalog happen here, inputs first and left before right; reads stay lazy, but for the counts of a bucket join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..catalog import Catalog, Snapshot, one_row, with_rows
from ..operators import relational
from ..sources import literal
from . import nodes


def compile_plan(spark: SparkSession, catalog: Catalog, node: nodes.Node) -> DataFrame | Snapshot | None:
    """The node's result; None for a dropped table, and after an insert what becomes a DataFrame when it is used."""
    if not isinstance(node, nodes.Node):
        raise TypeError(f"not a plan node: {node!r}")
    if isinstance(node, nodes.InsertRow) and isinstance(node.inputs()[0], nodes.GetTable):  # the table need not be read
        return catalog.insert(node.inputs()[0].name, node.row)
    done = [compile_plan(spark, catalog, x) for x in node.inputs()]
    if any(x is None for x in done):
        raise TypeError("DropTable has no result to go on with")
    done = [x.frame() if isinstance(x, Snapshot) else x for x in done]
    match node:
        case nodes.GetTable(name):
            return catalog.fetch(name)
        case nodes.CreateTable(name, data, size, schema):
            catalog.put(name, literal.table(spark, data, size, schema))
            return catalog.fetch(name)
        case nodes.DropTable(name):
            catalog.drop(name)
            return None
        case nodes.InsertRow(_, row):
            return with_rows(done[0], [one_row(len(done[0].columns), row)])
        case nodes.Scan(_, name, predicate):
            return relational.scan(done[0], name, predicate)
        case nodes.Projection(_, names):
            return relational.project(done[0], names)
        case nodes.HashBucketJoin():
            return relational.hash_bucket_join(*done, node.left_column, node.right_column, node.predicate, node.buckets, node.suffixes, node.strategy)
        case nodes.HashJoin():
            return relational.hash_join(*done, node.left_column, node.right_column, node.predicate, node.suffixes, node.strategy)
        case nodes.NestedLoopJoin():
            return relational.nested_loop_join(*done, node.left_column, node.right_column, node.predicate, node.suffixes, node.strategy)
    raise TypeError(f"unknown node: {type(node).__name__}")
