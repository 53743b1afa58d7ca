"""A small, composable query-plan API over Spark DataFrames."""

from .engine import Engine

__all__ = ["Engine"]
