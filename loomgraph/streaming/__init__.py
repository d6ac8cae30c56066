"""Graphs that grow while they are read."""
