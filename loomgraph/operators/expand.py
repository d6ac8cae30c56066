"""Adjacency as joins with the edge table."""

from __future__ import annotations

from collections.abc import Sequence
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import written

if TYPE_CHECKING:
    from ..graph import PropertyGraph

#: Rows that ``copies`` makes of one row at a time, and in a task.
COPY_BLOCK, TASK_COPIES = 1 << 16, 1 << 23


def labelled(edges: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Edges of these labels, all if none is named; the filter reaches the edges' scan."""
    return edges.where(F.col("label").isin(*labels)) if labels else edges


def half_edges(graph: PropertyGraph, labels: Sequence[str], direction: str, extra: Sequence[str] = ()) -> DataFrame:
    """``at, to`` and the columns of ``extra`` of each edge seen from its near end; "both" sees each edge twice, loops too."""
    edges = labelled(graph.edges if extra else graph.links, labels)
    seen = {"out": ("src", "dst"), "in": ("dst", "src")}
    parts = [edges.select(F.col(a).alias("at"), F.col(b).alias("to"), *[F.col(c).alias(f"e_{c}") for c in extra]) for a, b in (seen.values() if direction == "both" else [seen[direction]])]
    return parts[0] if len(parts) == 1 else parts[0].unionAll(parts[1])


def degree(graph: PropertyGraph, labels: Sequence[str] = (), direction: str = "out", of: DataFrame | None = None) -> DataFrame:
    """``id, degree`` of all vertices, or of the ids in ``of`` (one column); vertices without edges have 0."""
    ids = (of.toDF("id") if of is not None else graph.vertices.select("id")).distinct()
    counts = half_edges(graph, labels, direction).groupBy("at").agg(F.count(F.lit(1)).alias("n"))
    return ids.join(counts, F.col("id") == F.col("at"), "left").select("id", zero(F.col("n")).alias("degree"))


def zero(n: Column) -> Column:
    return F.coalesce(n, F.lit(0).cast("long"))


def copies(counts: DataFrame) -> DataFrame:
    """``cur`` of each row of ``counts`` (``cur, n``) ``n`` times, dealt so that no task makes many more than ``TASK_COPIES``."""
    counts = written(counts, "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    blocks = counts.where("n > 0").select("cur", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPY_BLOCK).cast("long"))).alias("low"))
    if total > TASK_COPIES:
        blocks = blocks.repartition(-(-total // TASK_COPIES), "cur", "low")
    return blocks.select(F.explode(F.array_repeat("cur", F.least(F.col("n") - F.col("low"), F.lit(COPY_BLOCK)).cast("int"))).alias("cur"))
