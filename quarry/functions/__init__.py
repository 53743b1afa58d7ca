"""Functions for predicates."""

from ..plans.predicates import condition, is_equality, opaque

__all__ = ["condition", "is_equality", "opaque"]
