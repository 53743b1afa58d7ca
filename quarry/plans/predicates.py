"""Predicates are Python callables over Columns, called once when a plan is compiled.

``lambda c: c < 55`` becomes an expression that Catalyst sees and pushes down.  Conditions are combined with
``&``, ``|`` and ``~``.  A function over values is possible with ``opaque``, at the cost of a Python UDF.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.errors import PySparkValueError
from pyspark.sql import Column
from pyspark.sql import functions as F


def opaque(fn: Callable[..., bool]) -> Callable[..., Column]:
    """A predicate from a function over values, run in Arrow batches; null arguments are passed as None."""

    def predicate(*columns: Column) -> Column:
        return F.udf(fn, "boolean", useArrow=True)(*columns)

    predicate.opaque = True
    return predicate


def condition(predicate: Callable[..., Any], *columns: Column) -> Column:
    """The predicate's expression over the columns; a bool stands for always or never."""
    try:
        found = predicate(*columns)
    except PySparkValueError as e:
        raise TypeError("a predicate makes one Column expression: use & | ~ and between() in place of and, or, not, chained comparisons and in") from e
    if isinstance(found, bool):
        return F.lit(found)
    if not isinstance(found, Column):
        raise TypeError(f"a predicate gives a Column or a bool, not {type(found).__name__}")
    return found


class _Side:
    """Stands in for a column and answers only to equality and order with the other side."""

    def __init__(self, name: str):
        self.name = name

    def __eq__(self, other: object) -> Any:
        return ("equal", frozenset((self.name, getattr(other, "name", None))))

    def __lt__(self, other: object) -> Any:
        return ("order", self.name, getattr(other, "name", None))

    def __gt__(self, other: object) -> Any:
        return ("order", getattr(other, "name", None), self.name)

    __le__, __ge__ = __lt__, __gt__
    __hash__ = None


def _asked(predicate: Callable[..., Any]) -> tuple | None:
    """What the predicate asks of its two arguments; None for anything but one equality or order."""
    if getattr(predicate, "opaque", False):
        return None
    try:
        found = predicate(_Side("l"), _Side("r"))
    except Exception:  # it asks the stand-ins for anything else
        return None
    return found if isinstance(found, tuple) else None


def is_equality(predicate: Callable[..., Any]) -> bool:
    """Whether the predicate is the equality of its two arguments, and nothing else."""
    return _asked(predicate) == ("equal", frozenset("lr"))


def order(predicate: Callable[..., Any]) -> str | None:
    """"lr" if the predicate is that its first argument is below the second (or equal), and nothing else; "rl" for above; None for any other."""
    return {("order", "l", "r"): "lr", ("order", "r", "l"): "rl"}.get(_asked(predicate))
