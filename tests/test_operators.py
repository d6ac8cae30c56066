"""Vector search, subgraphs and fixed points on small graphs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph import P, PropertyGraph
from loomgraph import anon as __
from loomgraph.functions.scalars import day_number, first_item, part_key, prompt, words
from loomgraph.functions.vectors import cosine, mean_of_word_vectors, mean_vector, norm
from loomgraph.operators.fixpoint import components, min_label, reachable, to_smallest
from loomgraph.operators.subgraph import edge_index
from loomgraph.operators.vector import nearest
from loomgraph.sources.readers import edge_list, from_arrays
from loomgraph.storage import clear, written, written_path

from .graphs import DS1, DS2, DS3, lines

EMB = [[1.1, 2.1], [2.2, 4.4], [3.3, 5.5], [4.4, 1.6], [5.5, 4.1], [6.6, 3.0], [-7.7, 9.9]]
QUERY = [[1.1, 2.1]]


@pytest.fixture(scope="module")
def emb7(spark):
    graph = from_arrays(spark, 7, range(7), [5, 4, 3, 2, 1, 6, 0], "link")
    graph.set_vertex_embeddings("emb", [], EMB)
    return graph


def test_similarity(emb7):
    g = emb7.traversal()
    got = {r.v: r.cur for r in g.V().as_("v").similarity("emb", QUERY).toDF(["v", "cur"]).collect()}
    for k, want in enumerate([1.0, 0.999822, 0.998324, 0.738798, 0.901446, 0.788976, 0.41436]):
        assert abs(got[k] - want) < 1e-5
    assert sorted(g.V().like("emb", QUERY, 0.90).toList()) == [0, 1, 2, 4]
    assert g.V().like("emb", QUERY, 3).toList() == [0, 1, 2]
    assert g.V().like("emb", QUERY, 0).toList() == []
    assert g.V().has("id", P.gt(0)).like("emb", QUERY, 2).toList() == [1, 2]
    assert g.V().like("emb", QUERY, 2).has("id", P.gt(0)).toList() == [1]
    assert sorted(g.V().like("emb", [[1.1, 2.1], [4.4, 1.6]], 2).toList()) == [0, 3]
    assert g.V().like("emb", QUERY, 2, metric="l2").toList() == [0, 1]
    assert g.V([3, 6]).as_("a").out().like("emb", QUERY, 1).toList() == [0]
    with pytest.raises(ValueError):
        g.V().similarity("none", QUERY).toList()
    with pytest.raises(ValueError):
        g.V().similarity("emb", QUERY, "other").toList()


def test_embeddings(spark):
    graph = from_arrays(spark, 4, [], [], "e")
    graph.set_vertex_embeddings("x", [1], [[1.0, 2.0]], default=9.0)
    assert {r.id: r.vec for r in graph.embedding("x").collect()} == {0: [9, 9], 1: [1, 2], 2: [9, 9], 3: [9, 9]}
    graph.set_vertex_embeddings_range("x", 2, 3, [[5, 5], [6, 6]])
    assert [r.vec for r in graph.get_vertex_embeddings("x", [3, 1, 77]).orderBy("place").collect()] == [[6, 6], [1, 2]]
    with pytest.raises(ValueError):
        graph.set_vertex_embeddings_range("x", 0, 3, [[1, 1]])
    assert graph.traversal().V(1).encode("x").next() == [1, 2]


def test_cells_recall(spark):
    r = np.random.default_rng(0)
    centres = r.normal(size=(12, 16))
    data = (centres[r.integers(0, 12, 600)] + 0.3 * r.normal(size=(600, 16))).tolist()
    graph = from_arrays(spark, 600, [], [], "e")
    graph.set_vertex_embeddings("emb", [], data)
    graph.make_vertex_embedding_index("emb")
    assert graph.indexes["emb"].table.count() == 600
    hits = 0
    for q in data[::100]:
        exact = {x.id for x in nearest(graph.embedding("emb"), [q], 10).collect()}
        hits += len(exact & set(graph.traversal().V().like("emb", [q], 10, approximate=True).toList()))
    assert hits >= 0.9 * 60
    graph.set_vertex_embeddings("emb", [0], [data[1]])
    assert graph.indexes == {}


@pytest.mark.parametrize(("text", "vertices", "edges", "parts", "most"), [(DS1, 8, 10, 1, 3), (DS2, 14, 14, 2, 2), (DS3, 7, 6, 1, 1)])
def test_components(spark, tmp_path, text, vertices, edges, parts, most):
    graph = edge_list(spark, lines(text, tmp_path / "g.txt"))
    assert (graph.num_vertices(), graph.num_edges()) == (vertices, edges)
    got = {r.id: r.component for r in components(graph).collect()}
    assert len(set(got.values())) == parts and got == {r.id: r.component for r in min_label(graph).collect()}
    assert graph.degree().agg(F.max("degree")).first()[0] == most
    if text != DS3:
        return
    # The same by the language: labels pass on until nothing changes.
    own = PropertyGraph(spark, graph.vertices, graph.edges)
    g = own.traversal()
    g.V().property("cc", __().id()).iterate()
    while True:
        g.V().property("old", __().values("cc")).iterate()
        g.V().property("cc", __().union([__().both().values("old"), __().values("old")]).min()).iterate()
        if not g.V().elementMap(["cc", "old"]).where("cc", P.neq("old")).count().next():
            break
    assert {r.id: r.value for r in own.view_vertex_property("cc").collect()} == got
    assert g.V().values("cc").dedup().count().next() == parts


def test_components_of_nothing(spark):
    graph = PropertyGraph(spark)
    assert components(graph).collect() == []
    graph.add_vertices(2)
    assert sorted(r.component for r in components(graph).collect()) == [0, 1]


def test_random_components(spark):
    r = random.Random(4)
    src, dst = ([r.randrange(200) for _ in range(150)] for _ in range(2))
    graph = from_arrays(spark, 200, src, dst, "e")
    label = list(range(200))
    for _ in range(200):
        for a, b in zip(src, dst, strict=True):
            label[a] = label[b] = min(label[a], label[b])
    assert {x.id: x.component for x in components(graph).collect()} == dict(enumerate(label))


def test_greedy_and_exact_arrivals(spark):
    graph = from_arrays(spark, 4, [0, 0, 2, 1], [1, 2, 1, 3], "flight")
    graph.set_edge_properties("time", range(4), [4, 1, 2, 3])
    start = spark.createDataFrame([(0,)], "id long")
    arrive = lambda mode: {r.id: r.last_time for r in reachable(graph, start, -1, 5, mode=mode).collect()}
    assert arrive("greedy") == {0: -1, 1: 4, 2: 1} and arrive("exact") == {0: -1, 1: 2, 2: 1, 3: 3}
    with pytest.raises(ValueError):
        reachable(graph, start, 0, 1, time="none")
    with pytest.raises(ValueError):
        arrive("other")


def test_greedy_by_the_language(spark):
    """The frontier loop as a chain: visited vertices are left out, the earliest edge to each is taken."""
    graph = from_arrays(spark, 4, [0, 0, 2, 1], [1, 2, 1, 3], "flight", {"name": list("sabc")})
    graph.set_edge_properties("time", range(4), [4, 1, 2, 3])
    g = graph.traversal()
    graph.declare_vertex_property("last_time", "int")
    graph.declare_vertex_property("visited", "int")
    g.V(0).property("last_time", -1).iterate()
    step = __().property("visited", 1).elementMap(["last_time"]).outE().has("time", P.lte(5)).elementMap(["time"]).where("time", P.gt("last_time")).as_("e").values("time").as_("at").select("e").inV().hasNot("visited").elementMap(["name"]).as_("v").select("at").min("name").select("v").property("last_time", __().select("at"))
    g.V(0).repeat(step).iterate()
    assert sorted(g.V().has("visited").toList()) == [0, 1, 2]
    assert {r.id: r.value for r in graph.view_vertex_property("last_time").collect()} == {0: -1, 1: 4, 2: 1}


def test_model_inputs(emb7):
    nodes, edges = edge_index(emb7, emb7.spark.createDataFrame([(0,), (1,)], "id long"), "emb")
    assert [(r.place, r.vid) for r in nodes.orderBy("place").collect()] == [(0, 0), (1, 1), (2, 4), (3, 5)]
    assert sorted((r.src, r.dst) for r in edges.collect()) == [(2, 1), (3, 0)]


def test_functions(spark):
    row = spark.range(1).select(
        day_number(F.lit("2019-01-05")).alias("day"), part_key(F.lit("/x/part_3_12.npy")).alias("k"), part_key(F.lit("other")).alias("none"),
        words(F.lit("  a  b\tc ")).alias("w"), first_item(F.array(F.lit("p"))).alias("f"), prompt(F.lit("Q"), F.lit(None).cast("string")).alias("p"),
        cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("zero"), norm(F.array(F.lit(3), F.lit(4))).alias("n"),
    ).first()
    assert row.day == 4 and tuple(row.k) == (3, 12) and tuple(row.none) == (None, None) and row.w == ["a", "b", "c"] and row.f == "p"
    assert row.p == "Question: Given the information below, Q\n\nAnswer:" and row.zero is None and row.n == 5
    vectors = spark.createDataFrame([([1.0, 2.0],), ([3.0, 6.0],)], "v array<double>")
    assert mean_vector(vectors, "v").first().vec == [2.0, 4.0]
    table = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "word string, vec array<double>")
    docs = spark.createDataFrame([(1, "a b b"), (2, "zz"), (3, None)], "id long, text string")
    got = {r.id: r.vec for r in mean_of_word_vectors(docs, "text", "id", table).collect()}
    assert math.isclose(got[1][1], 2 / 3) and got[2] == got[3] == [0.0, 0.0]


def test_a_hot_vertex_is_split(spark):
    """The join back on a vertex that nearly all edges share, as the rounds of components have it."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        now = written(spark.range(1, 60_000).select(F.col("id").alias("a"), F.when(F.col("id") % 7 == 6, 60_000).otherwise(0).cast("long").alias("b")).where("a <> b").repartition(16), "star")
        both = now.unionAll(now.select("b", "a"))
        low = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "low")
        large = to_smallest(both, low)
        large.collect()
        assert "skew=true" in large._jdf.queryExecution().executedPlan().toString().replace("isSkew", "skew")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_written_tables_can_be_cleared(spark):
    path = written_path(spark, "some")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    clear(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_few_ids_are_broadcast(spark):
    """A sequence of ids finds its elements where these are read: a table of elements is not dealt for it."""
    many = spark.range(5_000_000).select("id", F.lit("x").alias("label"), (F.col("id") % 7).alias("p"))
    graph = PropertyGraph(spark, many, many.select("id", F.col("id").alias("src"), F.col("id").alias("dst"), "label", "p"))
    ids = [3, 1, 3, 9_000_000]
    own = {"labels": graph.vertex_labels(ids), "edges": graph.edge_labels(ids), "values": graph.get_edge_properties("p", ids), "scan": graph.traversal().V(ids).toDF()}
    for df in own.values():
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
    assert sorted(map(tuple, own["labels"].collect())) == sorted(map(tuple, own["edges"].collect())) == [(0, 3, "x"), (1, 1, "x"), (2, 3, "x")]
    assert sorted(map(tuple, own["values"].collect())) == [(0, 3, 3), (1, 1, 1), (2, 3, 3)] and sorted(r.cur for r in own["scan"].collect()) == [1, 3, 3]
    assert graph.vertex_labels([]).collect() == []
    graph.set_vertex_properties("p", [1, 5_000_001], [40, 41])
    assert "SortMergeJoin" not in graph.vertices._jdf.queryExecution().executedPlan().toString()
    assert graph.vertices.where("p > 6").select("id", "p").collect() == [(1, 40)]


def test_stars_need_no_rounds(spark, monkeypatch):
    from loomgraph.operators import fixpoint

    graph = from_arrays(spark, 9, [0, 2, 1, 5, 0, 5], [2, 0, 8, 6, 0, 7], "e")
    want = {0: 0, 1: 1, 2: 0, 3: 3, 4: 4, 5: 5, 6: 5, 7: 5, 8: 1}
    with monkeypatch.context() as m:
        m.setattr(fixpoint, "to_smallest", lambda *_: pytest.fail("a round"))
        assert {r.id: r.component for r in components(graph).collect()} == want
    graph.add_edges([7, 8], [8, 4], "e")
    assert {r.id: r.component for r in components(graph).collect()} == want | dict.fromkeys((4, 5, 6, 7, 8), 1)


def test_hops_number_no_lines(spark, monkeypatch):
    """The order lines of the star are numbered when an edge's id or property is asked for, not for hops, degrees and components."""
    from loomgraph.sources import star as source

    with monkeypatch.context() as m:
        m.setattr(source, "numbered_lines", lambda *_: pytest.fail("lines are numbered"))
        graph = source.star(spark, "/root/testdata/sf0.001")
        hops = [sorted(graph.traversal().V().hasLabel("order").out("contains").toList()), graph.traversal().V().out("filled_by").count().next(), graph.degree(["contains"]).agg(F.sum("degree")).first()[0], components(graph, ["placed"]).count()]
    own = PropertyGraph(spark, graph.vertices, graph.edges)
    assert sorted(map(tuple, graph.links.collect())) == sorted(map(tuple, own.links.collect()))
    assert hops == [sorted(own.traversal().V().hasLabel("order").out("contains").toList()), own.traversal().V().out("filled_by").count().next(), own.degree(["contains"]).agg(F.sum("degree")).first()[0], components(own, ["placed"]).count()]
    graph.add_edges([1], [2], "contains")
    assert graph.links.where("src = 1 AND dst = 2").count() == 1
