"""A property graph and its traversal language on DataFrames: what is asked for is declared, Catalyst plans how it runs."""

from .functions.predicates import P
from .graph import PropertyGraph
from .traversal import Traversal, anon

__all__ = ["P", "PropertyGraph", "Traversal", "anon"]
