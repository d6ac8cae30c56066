"""Algorithms that run until nothing changes; each round is a table in the shared folder."""

from __future__ import annotations

from collections.abc import Sequence
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import Rounds
from .expand import half_edges, labelled

if TYPE_CHECKING:
    from ..graph import PropertyGraph


def to_smallest(both: DataFrame, low: DataFrame) -> DataFrame:
    """Large star: of ``both`` (each link from either end, ``a, b``) the neighbours above a node, linked to ``m``, which ``low`` has for each node ``a``."""
    return both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def stars(now: DataFrame) -> bool:
    """Whether every node ``a`` hangs on one other, ``b``, and on none that hangs itself; the rows are distinct."""
    return now.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty() and now.join(now.select(F.col("b").alias("r")).distinct(), F.col("a") == F.col("r"), "left_semi").isEmpty()


def rooted(links: DataFrame) -> DataFrame:
    """``a, b`` for each node ``a`` of ``links`` (two long columns ``a, b``, undirected) that isn't its component's smallest: ``b`` is.

    Large-star and small-star steps (Kiveris et al., Connected Components in MapReduce and Beyond, 2014): the rounds grow with the logarithm of a
    path's length; links that are stars already, as those to an owner, need none.  Minima are combined map-side, so a node of any degree is one
    row a task there.  They are written before they are joined back: both sides of the joins are then dealt as they are read, which lets AQE
    split the rows of a node of large degree.
    """
    spark = links.sparkSession
    nows, lows, larges, leasts = (Rounds(spark, f"components-{x}") for x in ("links", "low", "large", "least"))
    now = nows.keep(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while not stars(now):
        both = now.unionAll(now.select("b", "a"))
        low = lows.keep(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")))
        large = larges.keep(to_smallest(both, low).distinct())
        least = leasts.keep(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a")
        now = nows.keep(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
    for rounds in (lows, larges, leasts):
        rounds.drop()
    return now


def components(graph: PropertyGraph, labels: Sequence[str] = ()) -> DataFrame:
    """``id, component``: the smallest id that undirected edges reach, for every vertex."""
    roots = rooted(labelled(graph.links, labels).select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return graph.vertices.select("id").join(roots, F.col("id") == F.col("a"), "left").select("id", F.coalesce("b", "id").alias("component"))


def min_label(graph: PropertyGraph, labels: Sequence[str] = (), most: int = 10_000) -> DataFrame:
    """The same components by synchronous propagation of the smallest label; its rounds grow with the longest path, and more than ``most`` fail."""
    rounds = Rounds(graph.spark, "labels")
    edges = half_edges(graph, labels, "both").persist()
    now = rounds.keep(graph.vertices.select("id", F.col("id").alias("component")))
    for _ in range(most):
        reached = edges.join(now, F.col("to") == F.col("id")).groupBy("at").agg(F.min("component").alias("m"))
        new = rounds.keep(now.join(reached, F.col("id") == F.col("at"), "left").select("id", F.least("component", "m").alias("component"), (F.col("m") < F.col("component")).alias("moved")))
        now = new.select("id", "component")
        if new.where("moved").isEmpty():
            edges.unpersist()
            return now
    raise RuntimeError(f"labels still move after {most} rounds")


def reachable(graph: PropertyGraph, starts: DataFrame, begin: Column | int, end: Column | int, time: str = "time", labels: Sequence[str] = (), mode: str = "exact") -> DataFrame:
    """``id, last_time``: vertices reached by edges of rising times up to ``end``, included, each time above the arrival before it.

    ``starts`` (one column of ids) arrive at ``begin``, which edges must exceed.  ``greedy`` fixes a vertex's arrival in the round
    that first reaches it; ``exact`` goes on until no arrival gets earlier, and may reach more.
    """
    if mode not in ("greedy", "exact"):
        raise ValueError("mode is greedy or exact")
    if time not in graph.edge_property_names():
        raise ValueError(f"edges have no property {time!r}")
    rounds, later = Rounds(graph.spark, "reached"), Rounds(graph.spark, "front")
    to_lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    kind = graph.edges.schema[time].dataType
    edges = labelled(graph.edges, labels).select("src", "dst", F.col(time).alias("t")).where(F.col("t") <= to_lit(end))
    front = later.keep(starts.toDF("id").distinct().select("id", to_lit(begin).cast(kind).alias("last_time")))
    known = rounds.keep(front)
    while True:
        arrivals = front.join(edges, (F.col("id") == F.col("src")) & (F.col("t") > F.col("last_time"))).groupBy("dst").agg(F.min("t").alias("t"))
        old = known.select(F.col("id").alias("k"), F.col("last_time").alias("was"))
        both = arrivals.join(old, F.col("dst") == F.col("k"), "left")
        better = both.where("k IS NULL" if mode == "greedy" else "k IS NULL OR t < was")
        front = later.keep(better.select(F.col("dst").alias("id"), F.col("t").alias("last_time")))
        if front.isEmpty():
            return known
        known = rounds.keep(known.join(front.select(F.col("id").alias("k")), F.col("id") == F.col("k"), "left_anti").unionByName(front))
