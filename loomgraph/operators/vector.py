"""Similarity scores, thresholds and nearest neighbours.

Exact search scores every vector and keeps the best by a top-k that never sorts all.  The approximate one assigns vectors to cells of a
k-means fitted to a bounded sample and scores only the cells nearest to a query; with product quantisation it scores codes of a few numbers
a vector and asks the vectors themselves only for the best of these.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import METRICS, total, constant, score
from ..storage import written

#: Vectors that an index's cells are fitted to at most, and cells at most.
SAMPLE, MOST_CELLS = 20_000, 1024
PROBES = 8
#: Centres of each part of a vector that codes number, and how many times ``k`` codes are asked for their vectors.
CENTRES, MORE = 256, 10
#: Queries that go through the vectors together, and how many of them meet how many vectors at a time: what a task holds of scores.
QUERY_BLOCK, TILE = 1024, 256


def scored(vectors: DataFrame, queries: Sequence[Sequence[float]], metric: str, vec: str = "vec") -> DataFrame:
    """``vectors`` once for each query, with ``query`` and ``score``; the queries are literals, so nothing is joined."""
    scores = F.array(*[score(F.col(vec), constant(q), metric) for q in queries])
    return vectors.select("*", F.posexplode(scores).alias("query", "score"))


def nearest(vectors: DataFrame, queries: Sequence[Sequence[float]], k: int, metric: str = "cosine") -> DataFrame:
    """``id, query, score``: the ``k`` best of all pairs together (an id may recur with several queries); ties by id, then query."""
    if k == 0 or not queries:
        return scored(vectors, queries or [[0.0]], metric).select("id", "query", "score").limit(0)
    rows = scored(vectors, queries, metric).select("id", "query", "score").where(F.col("score").isNotNull())
    return rows.orderBy(F.desc("score"), "id", "query").limit(k)


def above(vectors: DataFrame, queries: Sequence[Sequence[float]], threshold: float, metric: str = "cosine") -> DataFrame:
    """``id, query, score`` of all pairs that score ``threshold`` or more."""
    return scored(vectors, queries, metric).where(F.col("score") >= threshold).select("id", "query", "score")


def _scores(x: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """Of each query (row) with each vector; NaN where a cosine has no value."""
    dots = queries @ x.T
    if metric == "dot":
        return dots
    squares, own = (x**2).sum(1)[None], (queries**2).sum(1)[:, None]
    if metric == "l2":
        return -np.sqrt(np.maximum(own + squares - 2 * dots, 0))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(own * squares > 0, dots / np.sqrt(own * squares), np.nan)


def _first(held: np.ndarray, best: np.ndarray, names: np.ndarray, value: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each query (row) the names and values of the ``k`` best so far, ties by name, once it has seen ``value`` of ``names`` too.

    Only rows and columns with a value that reaches a row's last place are sorted.
    """
    full = best.shape[1] == k
    reach = value >= best[:, -1:] if full else np.ones(value.shape, bool)
    rows, columns = np.flatnonzero(reach.any(1)), np.flatnonzero(reach.any(0))
    more = value[np.ix_(rows, columns)]
    near, most = np.hstack([held[rows], np.broadcast_to(names[columns], more.shape)]), np.hstack([best[rows], more])
    order = np.lexsort((near, -most), axis=1)[:, :k]
    near, most = np.take_along_axis(near, order, 1), np.take_along_axis(most, order, 1)
    if not full:
        return near, most
    held[rows], best[rows] = near, most
    return held, best


def nearest_each(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", index: CellIndex | None = None, probes: int = PROBES) -> DataFrame:
    """``query, id, score, rank``: the ``k`` best of ``vectors`` (``id, vec``) for each of ``queries`` (``id, vec``); ties by id.

    Queries go through all vectors in blocks of ``QUERY_BLOCK``, so what the driver and the executors hold is bounded.  A task scores ``TILE`` queries
    with ``TILE`` vectors at a time and keeps the best ``k`` of each query, and only these are dealt.  With ``index`` each query sees the vectors of its ``probes`` nearest cells.  Null vectors have no part.
    """
    if metric not in METRICS:
        raise ValueError(f"metric is one of {METRICS}")
    if not k:
        return vectors.sparkSession.createDataFrame([], "query long, id long, score double, rank int")
    rows = (index.table if index is not None else vectors).where("vec IS NOT NULL")
    columns = ["id", "vec", "cell"] if index is not None else ["id", "vec"]

    def block(ids: np.ndarray, own: np.ndarray) -> DataFrame:
        probed = index.probed(own, probes) if index is not None and len(index.centres) else None

        def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sizes = [len(ids[i : i + TILE]) for i in range(0, len(ids), TILE)]
            kept = [(np.empty((n, 0), np.int64), np.empty((n, 0))) for n in sizes]
            for frame in frames:
                for at in range(0, len(frame), TILE):
                    part = frame.iloc[at : at + TILE]
                    x, names = np.array(part["vec"].tolist(), float), part["id"].to_numpy()
                    for j, held in enumerate(kept):
                        some = slice(j * TILE, (j + 1) * TILE)
                        value = _scores(x, own[some], metric)
                        if probed is not None:
                            value = np.where(probed[some][:, part["cell"].to_numpy()], value, np.nan)
                        kept[j] = _first(*held, names, np.nan_to_num(value, nan=-np.inf), k)
            for j, (near, value) in enumerate(kept):
                out = pd.DataFrame({"query": np.repeat(ids[j * TILE : (j + 1) * TILE], near.shape[1]), "id": near.ravel(), "score": value.ravel()})
                yield out[out["score"] > -np.inf]

        return rows.select(*columns).mapInPandas(best, "query long, id long, score double")

    found, held = None, []

    def flush() -> None:
        nonlocal found, held
        if held:
            own = block(np.array([r.id for r in held], np.int64), np.array([r.vec for r in held], float))
            found, held = own if found is None else found.unionAll(own), []

    for r in queries.select("id", "vec").where("vec IS NOT NULL").toLocalIterator():
        held.append(r)
        if len(held) == QUERY_BLOCK:
            flush()
    flush()
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query long, id long, score double, rank int")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _kmeans(x: np.ndarray, k: int, seed: int, rounds: int) -> np.ndarray:
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = _nearest_cell(x, centres)
        size = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
    return centres


@dataclass
class CellIndex:
    """``id, vec, cell, norm, codes`` of every vector, written by cell; the cells' centres, and those that codes number, part by part."""

    table: DataFrame
    centres: np.ndarray
    parts: list[np.ndarray]

    @classmethod
    def fit(cls, vectors: DataFrame, cells: int | None = None, seed: int = 1, rounds: int = 12, parts: int = 8) -> CellIndex:
        """4 times the root of the number of vectors is the usual number of cells.  The sample is the smallest hashes of ids; null vectors are left out."""
        vectors = vectors.where("vec IS NOT NULL")
        n = vectors.count()
        if not n:
            return cls(vectors.select("id", "vec", F.lit(0).alias("cell")), np.zeros((0, 0)), [])
        rows = vectors.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(SAMPLE).select("vec").collect()
        sample = np.array([r.vec for r in rows], float)
        centres = _kmeans(sample, min(cells or int(4 * np.sqrt(n)), MOST_CELLS, max(1, len(sample) // 4)), seed, rounds)
        cut = np.array_split(np.arange(sample.shape[1]), min(parts, sample.shape[1]))
        numbered = [_kmeans(sample[:, c], min(CENTRES, len(sample)), seed + 1 + j, rounds) for j, c in enumerate(cut)]

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                x = np.array(batch["vec"].tolist(), float).reshape(len(batch), -1)
                if len(batch):
                    codes = np.stack([_nearest_cell(x[:, c], own) + j * CENTRES for j, (c, own) in enumerate(zip(cut, numbered, strict=True))], 1)
                    yield batch.assign(cell=_nearest_cell(x, centres), norm=np.sqrt((x**2).sum(1)), codes=list(codes))

        placed = vectors.select("id", "vec").mapInPandas(assign, "id long, vec array<float>, cell int, norm double, codes array<int>")
        return cls(written(placed.repartition("cell").sortWithinPartitions("cell"), "cells"), centres, numbered)

    def probed(self, queries: np.ndarray, probes: int) -> np.ndarray:
        """For each query, which cells are its nearest."""
        gone = np.stack([((q - self.centres) ** 2).sum(1) for q in queries]) if len(queries) else np.zeros((0, len(self.centres)))
        out = np.zeros(gone.shape, bool)
        np.put_along_axis(out, np.argsort(gone, axis=1, kind="stable")[:, :probes], True, 1)
        return out

    def nearest(self, queries: Sequence[Sequence[float]], k: int, metric: str = "cosine", probes: int = PROBES) -> DataFrame:
        """As ``nearest``, of vectors in the ``probes`` cells nearest to each query; the cell filter reaches the scan."""
        return nearest(self._probed_rows(queries, probes).select("id", "vec"), queries, k, metric)

    def _probed_rows(self, queries: Sequence[Sequence[float]], probes: int) -> DataFrame:
        if not len(self.centres):
            return self.table
        cells = np.flatnonzero(self.probed(np.array(queries, float), probes).any(0))
        return self.table.where(F.col("cell").isin(cells.tolist()))

    def nearest_by_codes(self, queries: Sequence[Sequence[float]], k: int, metric: str = "cosine", probes: int = PROBES, more: int = MORE) -> DataFrame:
        """As ``nearest``, by product quantisation: codes are scored from tables of each query's products with the centres, and the best
        ``more * k`` of all are scored again by their vectors.  Vectors are read for these only."""
        rows = self._probed_rows(queries, probes)
        if not len(self.centres) or not k or not queries:
            return nearest(rows.select("id", "vec"), queries, k, metric)
        scores = []
        for q in np.array(queries, float):
            cut = np.array_split(np.arange(len(q)), len(self.parts))
            products = np.zeros((len(cut), CENTRES))
            for j, (c, own) in enumerate(zip(cut, self.parts, strict=True)):
                products[j, : len(own)] = own @ q[c]
            table = constant(products.ravel())
            product = total(F.transform("codes", lambda c: F.element_at(table, c + 1)))  # noqa: B023
            size = float(np.sqrt((q**2).sum()))
            scores.append({"dot": product, "cosine": product / F.nullif(F.col("norm") * size, F.lit(0.0)), "l2": 2 * product - F.col("norm") * F.col("norm")}[metric])
        best = rows.select("id", F.posexplode(F.array(*scores)).alias("query", "near")).where(F.col("near").isNotNull()).orderBy(F.desc("near"), "id", "query").limit(more * k)
        # At most more * k ids: a bounded side.
        return nearest(rows.join(F.broadcast(best.select("id").distinct()), "id", "left_semi").select("id", "vec"), queries, k, metric)


def _nearest_cell(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int32)
    for i in range(0, len(x), 1024):
        part = x[i : i + 1024]
        out[i : i + 1024] = (-2 * part @ centres.T + (centres**2).sum(1)).argmin(1)
    return out
