"""Search by many queries, cells and codes; seeded draws; tables of CSV."""

import numpy as np
import pytest

from loomgraph.functions.scalars import joined_texts
from loomgraph.operators.sampling import drawn_settings, split
from loomgraph.operators.vector import CellIndex, nearest_each
from loomgraph.sources.readers import csv_tables
from loomgraph.sources.writers import write_csv, write_text_vectors


def clustered(n, seed=0, width=16):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(n // 20, width))
    return centres[r.integers(0, len(centres), n)] + 0.4 * r.normal(size=(n, width))


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + k, [float(v) for v in row]) for k, row in enumerate(x)], "id long, vec array<float>").repartition(5)


def brute(x, queries, k, metric):
    x, out = np.asarray(x, np.float32).astype(float), {}
    for i in queries:
        q = x[i]
        score = {"dot": x @ q, "cosine": x @ q / (np.linalg.norm(x, axis=1) * np.linalg.norm(q)), "l2": -np.linalg.norm(x - q, axis=1)}[metric]
        out[i] = np.lexsort((np.arange(len(x)), -score))[:k].tolist()
    return out


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
def test_each_query(spark, metric, monkeypatch):
    from loomgraph.operators import vector

    monkeypatch.setattr(vector, "QUERY_BLOCK", 3)
    x = clustered(400)
    vectors = frame(spark, x)
    got = nearest_each(vectors, vectors.where("id % 50 = 0"), 6, metric).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.query, r.rank)):
        found.setdefault(r.query, []).append(r.id)
    assert found == brute(x, range(0, 400, 50), 6, metric)
    odd = frame(spark, x[:3]).unionByName(spark.createDataFrame([(9, None), (10, [0.0] * 16)], "id long, vec array<float>"))
    assert {(r.query, r.id) for r in nearest_each(odd, odd, 2, "cosine").collect() if r.query < 3} <= {(a, b) for a in range(3) for b in range(3)}
    assert nearest_each(vectors.where("false"), vectors.limit(2), 3).collect() == [] == nearest_each(vectors, vectors.where("false"), 3).collect() == nearest_each(vectors, vectors.limit(2), 0).collect()


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_scores_are_held_in_tiles(spark, metric, monkeypatch):
    """A task holds scores of a few queries and vectors at a time, whatever a batch has, and gives ``k`` of each query whatever a task has."""
    from loomgraph.operators import vector

    x = clustered(600)
    x[300:400] = x[7]  # ties, more than k of them
    vectors = frame(spark, x).coalesce(1)
    queries, seen, scores = vectors.where("id % 20 = 7"), spark.sparkContext.accumulator(0), vector._scores

    def watched(own, q, metric):
        if own.shape[0] > 8 or q.shape[0] > 8:
            seen.add(1)
        return scores(own, q, metric)

    monkeypatch.setattr(vector, "TILE", 8, raising=False)
    monkeypatch.setattr(vector, "_scores", watched)
    got = {}
    rows = nearest_each(vectors, queries, 12, metric)
    for r in sorted(rows.collect(), key=lambda r: (r.query, r.rank)):
        got.setdefault(r.query, []).append((r.id, r.score))
    assert not seen.value
    x = np.asarray(x, np.float32).astype(float)
    for q in range(7, 600, 20):
        score = -np.linalg.norm(x - x[q], axis=1) if metric == "l2" else x @ x[q] / (np.linalg.norm(x, axis=1) * np.linalg.norm(x[q]))
        want = np.sort(score)[::-1][:12]
        assert len(got[q]) == 12 and np.allclose([s for _, s in got[q]], want, atol=1e-6) and np.allclose(score[[i for i, _ in got[q]]], want, atol=1e-6)


def test_recall_of_cells_and_codes(spark):
    """Nine in ten of the true neighbours, over all ids that divide by 100."""
    x = clustered(3000, 1)
    vectors = frame(spark, x)
    index = CellIndex.fit(vectors)
    want = brute(x, range(0, 3000, 100), 10, "cosine")
    got = {}
    for r in nearest_each(vectors, vectors.where("id % 100 = 0"), 10, index=index, probes=24).collect():
        got.setdefault(r.query, set()).add(r.id)
    assert sum(len(got[q] & set(ids)) for q, ids in want.items()) >= 0.9 * 10 * len(want)
    hit = 0
    for metric in ("cosine", "dot", "l2"):
        for q in (0, 700, 2900):
            own = [r.id for r in index.nearest_by_codes([x[q].tolist()], 10, metric, probes=len(index.centres)).collect()]
            hit += len(set(own) & set(brute(x, [q], 10, metric)[q]))
    assert hit >= 0.9 * 90
    assert index.table.count() == 3000 and index.nearest_by_codes([x[0].tolist()], 0).collect() == []


def test_draws(spark):
    grid = {"a": [1, 2, 3], "b": ["x", "y"], "c": [0.5]}
    own = drawn_settings(grid, 4, seed=2)
    assert own == drawn_settings(grid, 4, seed=2) and len({tuple(s.values()) for s in own}) == 4
    assert len(drawn_settings(grid, 99)) == 6 and all(s[k] in grid[k] for s in own for k in grid)
    rows = spark.range(4000)
    parts = split(rows, [3, 1], ["id"], seed=1)
    ids = [{r.id for r in p.collect()} for p in parts]
    assert ids[0] | ids[1] == set(range(4000)) and not ids[0] & ids[1] and abs(len(ids[0]) - 3000) < 150
    assert {r.id for r in split(rows.repartition(7), [3, 1], ["id"], seed=1)[1].collect()} == ids[1]
    with pytest.raises(ValueError):
        split(rows, [0.0], ["id"])


def test_tables_and_texts(spark, tmp_path):
    write_csv(spark.createDataFrame([(1, "DE", 1999), (2, None, None), (None, "US", 2000)], "id long, country string, year int"), str(tmp_path / "v"))
    write_csv(spark.createDataFrame([(1, 2), (2, None)], "a long, b long"), str(tmp_path / "e"))
    graph = csv_tables(spark, str(tmp_path / "v"), "id long, country string, year int", "id", str(tmp_path / "e"), "a long, b long", "a", "b", "cites", "patent", drop=["country"])
    assert sorted((r.id, r.label, r.year) for r in graph.vertices.collect()) == [(1, "patent", 1999), (2, "patent", None)]
    assert [(r.src, r.dst, r.label) for r in graph.edges.collect()] == [(1, 2, "cites")]
    texts = spark.createDataFrame([("g", 2, "b"), ("g", 1, None), ("g", 1, "a"), ("h", 1, None)], "k string, n int, t string")
    assert {r.k: r.context for r in joined_texts(texts, ["k"], "t", ["n"], "|").collect()} == {"g": "|a|b", "h": ""}
    words = spark.createDataFrame([("a", [1.0, 3.0]), ("b", [3.0, 5.0])], "word string, vec array<double>")
    write_text_vectors(texts.selectExpr("n AS id", "t").where("t IS NOT NULL"), "t", "id", words, str(tmp_path / "vec"))
    assert {r.id: r.vec for r in spark.read.parquet(str(tmp_path / "vec")).collect()} == {1: [1.0, 3.0], 2: [3.0, 5.0]}
