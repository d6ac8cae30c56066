"""Subgraphs induced by edges."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import numbered
from ..storage import written

if TYPE_CHECKING:
    from ..graph import PropertyGraph

#: The label that a subgraph's edges get (fixed value).
RETRIEVED = "retrieved_edge"


def _parts(graph: PropertyGraph, edge_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    edges = written(edge_ids.toDF("edge").join(graph.edges.select("id", "src", "dst"), F.col("edge") == F.col("id")).select("id", "src", "dst"), "subgraph")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("vid")).distinct()
    places = written(numbered(ends, "place", F.col("vid")), "subgraph")
    return edges, places


def coo(graph: PropertyGraph, edge_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(place, vid)`` of the edges' vertices in order of their ids, and ``(edge, src, dst)`` with ends as places; repeats of an edge stay."""
    edges, places = _parts(graph, edge_ids)
    a, b = (places.select(F.col("vid").alias(f"v_{c}"), F.col("place").alias(f"p_{c}")) for c in "ab")
    ends = edges.join(a, F.col("src") == F.col("v_a")).join(b, F.col("dst") == F.col("v_b"))
    return places.select("place", "vid"), ends.select(F.col("id").alias("edge"), F.col("p_a").alias("src"), F.col("p_b").alias("dst"))


def subgraph(graph: PropertyGraph, edge_ids: DataFrame) -> PropertyGraph:
    """A graph of its own: vertices and edges renumbered, ``original_id`` on both, labels and other properties left behind."""
    from ..graph import PropertyGraph

    places, ends = coo(graph, edge_ids)
    vertices = places.select(F.col("place").alias("id"), F.lit("").alias("label"), F.col("vid").alias("original_id"))
    edges = numbered(ends, "id", F.col("edge"), F.col("src"), F.col("dst"))
    return PropertyGraph(graph.spark, vertices, edges.select("id", "src", "dst", F.lit(RETRIEVED).alias("label"), F.col("edge").alias("original_id")))


def edge_index(graph: PropertyGraph, edge_ids: DataFrame, embedding: str) -> tuple[DataFrame, DataFrame]:
    """What a graph model takes: ``(place, vid, vec)``, and edges turned round as ``(src, dst)``."""
    places, ends = coo(graph, edge_ids)
    vectors = graph.embedding(embedding)
    return places.join(vectors, places["vid"] == vectors["id"]).select("place", "vid", "vec"), ends.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
