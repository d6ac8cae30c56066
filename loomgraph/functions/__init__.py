"""Predicates and column functions of the traversal language."""
