"""Exact row ids, and what can be done with them.

A row id is the row's place, from 0 on, in the order of ``order_by``; rows that are equal there go by their other
columns.  Ids are made when they are asked for: the rows are sorted over all tasks and what is needed of them is kept in the checkpoint
folder; each task's rows are then counted, so that no task numbers more than its own.  Columns may have any names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import checkpoints
from ..plans.predicates import condition
from .relational import column

#: The bits of an id from Spark that number a row within its task.
WITHIN = 33
BUCKETS = 50


def _numbered(df: DataFrame, order_by: str | Sequence[str], keep: Sequence[Column]) -> DataFrame:
    """``rid`` and the columns ``keep`` as ``c0``, ``c1`` and so on."""
    first = [order_by] if isinstance(order_by, str) else list(order_by)
    rest = [f.name for f in df.schema if f.name not in first and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    checkpoints(df.sparkSession)
    names, keys = [f"c{i}" for i in range(len(keep))], [f"k{i}" for i in range(len(first + rest))]
    few = df.select(*(c.alias(n) for n, c in zip(names, keep, strict=True)), *(column(df, n).alias(k) for k, n in zip(keys, first + rest, strict=True)))
    rows = few.orderBy(*keys).select(*names, F.monotonically_increasing_id().alias("at")).checkpoint()
    task = F.shiftright("at", WITHIN).alias("task")
    counts = rows.groupBy(task).agg(F.count("*").alias("n"))  # a row for each task
    before = counts.select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("before"))
    place = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << WITHIN) - 1))
    return rows.select("*", task).join(F.broadcast(before), "task").select(place.alias("rid"), *names)


def with_row_ids(df: DataFrame, order_by: str | Sequence[str], name: str = "rid") -> DataFrame:
    """``df`` with its row ids as the last column, a bigint."""
    rows = _numbered(df, order_by, [column(df, n) for n in df.columns])
    return rows.select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(df.columns)), F.col("rid").alias(name))


def filter_row_ids(df: DataFrame, name: str, predicate, order_by) -> DataFrame:
    """``rid`` of the rows where the predicate holds, ascending."""
    rows = _numbered(df, order_by, [column(df, name)])
    return rows.where(condition(predicate, F.col("c0"))).select("rid").orderBy("rid")


def _ids(df: DataFrame, ids: Sequence[int]) -> DataFrame:
    return df.sparkSession.createDataFrame(list(enumerate(ids)), "pos bigint, id bigint")


def gather(df: DataFrame, name: str, ids: Sequence[int] | None, order_by, positions: bool = False) -> DataFrame:
    """The column's values at the ids, in the order of the ids and as often as they occur there; all values without ids.

    With ``positions`` there is also ``pos``, the place of each, as tables have no order.
    """
    rows = _numbered(df, order_by, [column(df, name)])
    found = rows.select(F.col("rid").alias("pos"), "c0") if ids is None else rows.join(_ids(df, ids), F.col("rid") == F.col("id")).select("pos", "c0")
    return found.orderBy("pos").select(*(["pos"] if positions else []), F.col("c0").alias(name))


def gather_optional(df: DataFrame, names: str | Sequence[str], ids: Sequence[int], order_by) -> DataFrame:
    """``rid`` and the columns of every row, null where its id isn't among the ids."""
    some = [names] if isinstance(names, str) else list(names)
    asked = _ids(df, sorted(set(ids))).select("id")
    rows = _numbered(df, order_by, [column(df, n) for n in some]).join(asked, F.col("rid") == F.col("id"), "left")
    return rows.select("rid", *(F.when(F.col("id").isNotNull(), F.col(f"c{i}")).alias(n) for i, n in enumerate(some)))


def hash_buckets(df: DataFrame, name: str, buckets: int = BUCKETS) -> DataFrame:
    """``hash_key`` (the value's remainder, with its sign) and ``n``, the rows there."""
    return df.groupBy((column(df, name) % buckets).alias("hash_key")).agg(F.count("*").alias("n"))


def hash_entries(df: DataFrame, name: str, order_by, buckets: int = BUCKETS) -> DataFrame:
    """``hash_key``, ``row_id`` and ``value`` of every row, one row each: a bucket of any size stays distributed."""
    rows = _numbered(df, order_by, [column(df, name)])
    return rows.select((F.col("c0") % buckets).alias("hash_key"), F.col("rid").alias("row_id"), F.col("c0").alias("value"))


def probe_indices(left: DataFrame, right: DataFrame, left_column: str, right_column: str, left_order, right_order, predicate=lambda a, b: a == b) -> DataFrame:
    """``left_row`` and ``right_row``, the row ids of every two rows for which the predicate holds."""
    a = _numbered(left, left_order, [column(left, left_column)]).select(F.col("rid").alias("left_row"), F.col("c0").alias("a"))
    b = _numbered(right, right_order, [column(right, right_column)]).select(F.col("rid").alias("right_row"), F.col("c0").alias("b"))
    return a.join(b, condition(predicate, F.col("a"), F.col("b"))).select("left_row", "right_row")


def partitions(df: DataFrame) -> DataFrame:
    """``partition`` and ``n``, the rows in it, of every partition that has rows as the table is read now."""
    return df.select(F.spark_partition_id().alias("partition")).groupBy("partition").agg(F.count("*").alias("n"))


def column_size(df: DataFrame, name: str) -> DataFrame:
    """``size``, the number of the column's values, nulls included."""
    return df.select(column(df, name)).agg(F.count(F.lit(1)).alias("size"))
