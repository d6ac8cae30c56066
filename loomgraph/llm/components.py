"""Connected components of a link table that may be far larger than one machine's memory.

Each task first contracts its own links to a forest.  Where at most ``CHUNK`` links are left, one more task contracts these; else the rest is the
library's large-star and small-star rounds (``rooted``), each a written table.  Nothing comes to the driver but counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.fixpoint import rooted
from .common import written

#: Links that a task contracts at once (some 20 MB).
CHUNK = 500_000


def roots_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links (a, b), and for each the smallest node it is linked to."""
    nodes, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = both[: len(a)], both[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = np.minimum(new, new[new])
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def forest() -> pa.RecordBatch:
        a = np.concatenate([x.column(0).to_numpy() for x in held])
        b = np.concatenate([x.column(1).to_numpy() for x in held])
        node, root = roots_of(a, b)
        keep = node != root
        return pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(root[keep])], ["a", "b"])

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= CHUNK:
            yield forest()
            held, n = [], 0
    if n:
        yield forest()


def connected_components(links: DataFrame) -> DataFrame:
    """``node, root`` for each node that ``links`` (two long columns, undirected, repeats and loops allowed) has with another.

    ``root`` is the smallest node of the component.  Links with a null end are no links.  No links: an empty table.
    """
    a, b = links.columns
    plain = links.select(links[a].cast("long").alias("a"), links[b].cast("long").alias("b")).where("a <> b")
    forest = "a long, b long"
    now = written(plain.mapInArrow(_contract, forest), "forests")
    now = written(now.coalesce(1).mapInArrow(_contract, forest), "forests") if now.count() < CHUNK else rooted(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
