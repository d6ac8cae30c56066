"""Traversals as plans: steps, the rewrites that act on them, and the compiler to DataFrames."""
