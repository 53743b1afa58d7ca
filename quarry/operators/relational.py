"""Scan, projection and the joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ColumnCollision, ColumnNotFound, NotAnEquiJoin
from ..plans.predicates import condition, is_equality, order
from . import blocks


def column(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        raise ColumnNotFound(f"{name}; there are {', '.join(df.columns) or 'none'}")
    return df[f"`{name}`"]


def scan(df: DataFrame, name: str, predicate) -> DataFrame:
    return df.where(condition(predicate, column(df, name)))


def project(df: DataFrame, names: Sequence[str]) -> DataFrame:
    if len(set(names)) < len(names):
        raise ColumnCollision("a column is asked for twice")
    found = df.select(*(column(df, n) for n in names))
    return found if names else found.limit(0)


def _named(left: DataFrame, right: DataFrame, suffixes: tuple[str, str] | None) -> tuple[list[str], list[str]]:
    """Names of the result's columns: only those on both sides get a suffix."""
    both = set(left.columns) & set(right.columns)
    if both and suffixes is None:
        raise ColumnCollision(f"on both sides: {', '.join(sorted(both))}; give suffixes")
    names = [[n + s if n in both else n for n in df.columns] for df, s in zip((left, right), suffixes or ("", ""), strict=True)]
    if len({*names[0], *names[1]}) < len(names[0]) + len(names[1]):
        raise ColumnCollision("the suffixes make names that are there already")
    return names[0], names[1]


def _join(left: DataFrame, right: DataFrame, left_column: str, right_column: str, on, suffixes, strategy: str | None, instead=None) -> DataFrame:
    """Inner join, left columns before right ones.  Both sides are renamed, so a table can be joined with itself.

    ``instead`` may do it in another way; it takes the renamed sides and the names of their keys.
    """
    for df, name in ((left, left_column), (right, right_column)):
        column(df, name)
    names = _named(left, right, suffixes)
    sides = [df.toDF(*(f"{side}{i}" for i in range(len(df.columns)))) for side, df in zip("lr", (left, right), strict=True)]
    keys = (f"l{left.columns.index(left_column)}", f"r{right.columns.index(right_column)}")
    other = sides[1].hint(strategy) if strategy else sides[1]
    found = sides[0].join(other, on(*map(F.col, keys)), "inner")
    better = instead(*sides, keys) if instead else None
    return (found if better is None else better).toDF(*names[0], *names[1])


def nested_loop_join(left: DataFrame, right: DataFrame, left_column: str, right_column: str, predicate, suffixes=None, strategy=None) -> DataFrame:
    return _join(left, right, left_column, right_column, lambda a, b: condition(predicate, a, b), suffixes, strategy)


def hash_join(left: DataFrame, right: DataFrame, left_column: str, right_column: str, predicate=None, suffixes=None, strategy=None) -> DataFrame:
    if predicate is not None and not is_equality(predicate):
        raise NotAnEquiJoin("a hash join is by equality; NestedLoopJoin takes any predicate, HashBucketJoin any within hash buckets")
    return _join(left, right, left_column, right_column, lambda a, b: a == b, suffixes, strategy)


def hash_bucket_join(left: DataFrame, right: DataFrame, left_column: str, right_column: str, predicate, buckets: int = 50, suffixes=None, strategy=None) -> DataFrame:
    """The remainder has the sign of the value, on both sides alike.  Unless it is by equality, rows are counted now, and many are joined in blocks."""

    def in_blocks(a: DataFrame, b: DataFrame, keys: tuple[str, str]) -> DataFrame | None:
        return blocks.join(a, b, keys, buckets, condition(predicate, *map(F.col, keys)), order(predicate), strategy)

    spark_alone = is_equality(predicate) or left.isStreaming or right.isStreaming
    on = lambda a, b: (a % buckets == b % buckets) & condition(predicate, a, b)
    return _join(left, right, left_column, right_column, on, suffixes, strategy, None if spark_alone else in_blocks)
