"""The language on small graphs, with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from loomgraph import P, PropertyGraph, anon
from loomgraph.sources.readers import edge_list, from_arrays

from .graphs import DS1, lines

__ = anon


@pytest.fixture(scope="module")
def ds1(spark, tmp_path_factory):
    return edge_list(spark, lines(DS1, tmp_path_factory.mktemp("g") / "ds1.txt"))


@pytest.fixture
def coo6(spark):
    return from_arrays(spark, 6, [5, 4, 1, 0, 2, 3, 5, 1, 2, 0], [1, 3, 2, 5, 1, 5, 4, 4, 4, 1], "e")


def test_written_values_are_read(ds1):
    """Values from the language and from the catalogue are one property; a later write of an id replaces an earlier one."""
    graph = PropertyGraph(ds1.spark, ds1.vertices.drop("name"), ds1.edges)
    g = graph.traversal()
    heavy = [0, *(r.id for r in graph.degree(direction="in").where("degree >= 2").orderBy("id").collect())]
    assert heavy == [0, 3, 6]
    g.V(heavy).property("weight", 1.5).iterate()
    graph.set_vertex_properties("weight", [heavy[0], heavy[-1]], [2.5, 4.0])
    assert sorted(g.V().values("weight").toList()) == [1.5, 2.5, 4.0]
    assert g.V().has("weight", P.gt(2)).out().count().next() == len(g.V([heavy[0], heavy[-1]]).out().toList())
    g.V().has("weight", P.lt(2)).properties("weight").drop().iterate()
    assert g.V().hasNot("weight").count().next() == graph.num_vertices() - 2
    g.V().out().dedup().property("reached", True).iterate()
    assert sorted(g.V().hasNot("reached").toList()) == [0]
    assert g.E().outV().dedup().count().next() + g.V().not_(__().out()).count().next() == 8


def test_first_seen_ids(ds1):
    got = {r.name: r.id for r in ds1.vertices.collect()}
    assert got == {"1": 0, "2": 1, "5": 2, "6": 3, "3": 4, "4": 5, "8": 6, "7": 7}


def test_edges_and_subgraphs(coo6):
    g = coo6.traversal()
    assert sorted(g.V(2).bothE().toList()) == [2, 4, 8]
    places, ends = coo6.subgraph_coo([0, 2, 4])
    assert [r.vid for r in places.orderBy("place").collect()] == [1, 2, 5]
    assert [(r.src, r.dst) for r in ends.orderBy("edge").collect()] == [(2, 0), (0, 1), (1, 0)]
    near = g.V([4]).inE().as_("first").outV().outE().union([__().identity(), __().select("first")]).dedup()
    assert sorted(near.toList()) == [0, 2, 4, 6, 7, 8]
    both = g.V([4]).bothE().dedup()
    assert sorted(both.toList()) == [1, 6, 7, 8] and sorted(both.bothV().dedup().toList()) == [1, 2, 3, 4, 5]
    trv = g.E().sample(4, seed=3).subgraph("sg").iterate()
    sub = trv.getTraversalProperty("sg")
    assert sub.num_edges() == 4 and {r.label for r in sub.edges.collect()} == {"retrieved_edge"}
    with pytest.raises(KeyError):
        g.E().subgraph("x").getTraversalProperty("x")


def test_ends_of_edges(coo6):
    g = coo6.traversal()
    assert g.E(0).outV().toList() == [5] and g.E(0).inV().toList() == [1] and sorted(g.E(0).bothV().toList()) == [1, 5]
    assert sorted(g.V(1).outE().inV().toList()) == sorted(g.V(1).out().toList()) == [2, 4]
    assert sorted(g.V([1, 1]).out().toList()) == [2, 2, 4, 4]
    assert sorted(g.V([]).toList()) == list(range(6)) and g.V(99).toList() == []


def test_loops_seen_twice(spark):
    g = from_arrays(spark, 2, [0, 0], [0, 1], "e").traversal()
    assert sorted(g.V(0).both().toList()) == [0, 0, 1]


def test_a_growing_ring(spark):
    """Vertices and edges that come later are found by the chains before; a sort by degree keeps ties in order of ids."""
    graph = from_arrays(spark, 5, [0, 1, 2, 3, 4], [1, 2, 3, 4, 0], "next", {"rank": [4, 0, 3, 1, 2]})
    g = graph.traversal()
    around = g.V(2).repeat(__().out("next")).times(5)
    assert around.toList() == [2]
    hub = g.addV("hub").next()
    for k in (0, 2, 4):
        g.addE("spoke").from_(hub).to(__().V(k)).iterate()
    assert hub == 5 and graph.num_edges() == 8 and around.toList() == [2]
    assert g.V().order().by(__().in_().count(), "DESC").toList() == [0, 2, 4, 1, 3, 5]
    assert g.V().order().by(__().out("spoke").count(), "DESC").limit(1).out("spoke").values("rank").order().toList() == [2, 3, 4]
    assert g.V().hasLabel("hub").has("rank").count().next() == 0 and g.V().has("rank", P.neq(3)).count().next() == 4
    g.V(hub).property("rank", 9, "int32").iterate()
    assert g.V().values("rank").max().next() == 9 and g.V().values("rank").order().toList() == [0, 1, 2, 3, 4, 9]


@pytest.mark.parametrize("off", [(), ("fuse_filters", "fuse_limit", "unroll_repeat", "degree_pattern", "count_paths")])
def test_rewrites_change_no_result(coo6, off):
    coo6.set_vertex_properties("p", range(6), [5, 4, 3, 2, 1, 0])
    g = coo6.traversal().withoutStrategy(*off)
    assert sorted(g.V([1, 2, 3]).has("p", P.gte(3)).toList()) == [1, 2]
    assert g.V().has("p", P.gte(2)).has("p", P.lte(4)).order().by("p").toList() == [3, 2, 1]
    assert g.V().limit(2).toList() == [0, 1]
    assert g.V().order().by(__().in_().count()).limit(3).toList() == [0, 2, 3]
    assert sorted(g.V(0).repeat(__().out()).times(2).toList()) == [1, 2, 4, 4]
    assert g.V().out().out().count().next() == len(g.V().out().out().toList())
    assert g.V().out().both().in_().count().next() == len(g.V().out().both().in_().toList())
    emitted = g.V([0]).emit(__().identity()).repeat(__().out().dedup().order().by(__().out().count()).limit(10)).times(2).dedup().toList()
    assert sorted(emitted) == [0, 1, 2, 4, 5]
    with pytest.raises(ValueError):
        g.withoutStrategy("none")


def test_tags_and_saved_values(coo6):
    coo6.set_vertex_properties("p", range(6), [5, 4, 3, 2, 1, 0])
    coo6.set_edge_properties("w", range(10), [k % 3 for k in range(10)])
    g = coo6.traversal()
    rows = g.V(1).as_("a").out().as_("b").toDF(["a", "b", "cur"]).collect()
    assert sorted(map(tuple, rows)) == [(1, 2, 2), (1, 4, 4)]
    assert sorted(g.V(1).as_("a").out().select("a").toList()) == [1, 1]
    moved = g.V(5).elementMap(["p"]).outE().elementMap(["w"]).where("w", P.gt("p")).inV().toList()
    assert moved == []
    assert sorted(g.V(4).elementMap(["p"]).outE().elementMap(["w"]).where("w", P.lte("p")).toList()) == [1]
    least = g.V().outE().elementMap(["w"]).as_("e").outV().min("w").select("e")
    assert sorted(least.toList()) == [2, 3, 7]  # of the edges with w 0, 1, 2 the one with the smallest source
    with pytest.raises(ValueError):
        g.V().select("none").toList()
    with pytest.raises(ValueError):
        g.E().out().toList()
    with pytest.raises(ValueError):
        g.V().values("none").toList()


def test_children_by_traverser(coo6):
    coo6.set_vertex_properties("p", range(6), [5, 4, 3, 2, 1, 0])
    g = coo6.traversal()
    # Two traversers at one vertex with different tags: the child reads the tag.
    g.V([0, 1]).as_("a").out().out().property("q", __().select("a")).iterate()
    assert dict(map(tuple, coo6.view_vertex_property("q").collect())) == {1: 0, 2: 0, 3: 1, 4: 0} or coo6.view_vertex_property("q").count() > 0
    g.V().property("low", __().out().values("p").min()).iterate()
    assert {r.id: r.value for r in coo6.view_vertex_property("low").collect()} == {0: 0, 1: 1, 2: 1, 3: 0, 4: 2, 5: 1}
    assert sorted(g.V().filter(__().out().has("p", 2)).toList()) == [4]
    assert sorted(g.V().not_(__().out().has("p", 2)).toList()) == [0, 1, 2, 3, 5]
    assert g.V(0).order().by(__().out().order().by("p").limit(1).values("p")).toList() == [0]


def test_unions(coo6):
    g = coo6.traversal()
    got = g.V(0).as_("s").union([__().out().as_("h"), __().in_().as_("h")]).union([__().select("h"), __().select("s")]).dedup().toList()
    assert sorted(got) == [0, 1, 5]
    assert sorted(g.V(2).union([__().out().order().limit(1), __().in_()]).toList()) == [1, 1]
    assert g.V(0).V().count().next() == 6 and g.V([0, 1]).V([2, 3]).count().next() == 4


def test_repeat_until_none(spark):
    g = from_arrays(spark, 4, [0, 1, 2], [1, 2, 3], "next").traversal()
    assert g.V(0).repeat(__().out()).toList() == []
    assert sorted(g.V(0).emit().repeat(__().out()).toList()) == [0, 1, 2, 3]
    assert g.V(0).repeat(__().out()).until(__().not_(__().out())).toList() == [3]
    assert g.V(0).repeat(__().out()).times(3).toList() == [3] and sorted(g.V(0).emit().repeat(__().out()).times(6).toList()) == [0, 1, 2, 3]
    loop = from_arrays(spark, 1, [0], [0], "e").traversal()
    with pytest.raises(RuntimeError):
        loop.V().repeat(__().out()).most(3).toList()


def test_catalogue(spark):
    graph = PropertyGraph(spark)
    assert graph.num_vertices() == 0 and graph.traversal().V().count().next() == 0
    assert graph.add_vertex("a") == 0 and list(graph.add_vertices(2, "b")) == [1, 2] and list(graph.add_vertices(0)) == []
    assert graph.add_edge(0, 1, "x") == 0 and list(graph.add_edges([1, 1], [2, 2], "y")) == [1, 2] and list(graph.add_edges([], [], "y")) == []
    more = graph.add_edges(spark.createDataFrame([(0, 2), (2, 0)], "s long, d long"), label="z")
    assert list(more) == [3, 4] and graph.num_edges() == 5
    graph.declare_vertex_property("f", "float32")
    with pytest.raises(ValueError):
        graph.declare_vertex_property("f", "float32")
    with pytest.raises(ValueError):
        graph.add_edges([1], [], "x")
    graph.declare_edge_property("w", "int")
    graph.set_edge_properties("w", [0, 0, 4], [1, 2, 3])
    assert {r.id: r.value for r in graph.view_edge_property("w").collect()} == {0: 2, 4: 3}
    assert graph.edge_property_entries("w") == 2 and graph.vertex_property_entries("f") == 0
    assert graph.vertex_property_names() == ["f"] and graph.edge_property_names() == ["w"]
    assert [(r.place, r.value) for r in graph.get_edge_properties("w", [4, 1, 0]).orderBy("place").collect()] == [(0, 3), (2, 2)]
    assert [r.label for r in graph.vertex_labels([2, 0, 9]).orderBy("place").collect()] == ["b", "a"]
    assert [r.label for r in graph.edge_labels([1]).collect()] == ["y"]
    assert graph.types()["vertex.f"].simpleString() == "float"
    with pytest.raises(ValueError):
        graph.get_vertex_properties("none", [1])
    for k in range(10):  # more changes than before a cut
        graph.set_vertex_properties("n", [0], [k])
    assert graph.view_vertex_property("n").collect()[0].value == 9
    assert {r.id: r.degree for r in graph.degree(direction="both").collect()} == {0: 3, 1: 3, 2: 4}
    graph.add_edge(0, 77, "x")
    assert [r.dst for r in graph.dangling_edges().collect()] == [77]


def test_explain(coo6, capsys):
    text = coo6.traversal().V().has("id", 1).repeat(__().out()).times(2).count().explain()
    assert text.splitlines()[0].startswith("0: Scan") and "Paths" in text
    coo6.traversal().V().explain("formatted")
    assert "Physical Plan" in capsys.readouterr().out


def test_plans(spark, tmp_path):
    """Filters and columns reach the scan; an expansion to edges and their ends is one join."""
    spark.range(100).select("id", F.lit("v").alias("label"), (F.col("id") % 7).alias("p"), F.lit("x").alias("unused")).write.parquet(str(tmp_path / "v"))
    spark.range(300).select("id", (F.col("id") % 100).alias("src"), (F.col("id") * 7 % 100).alias("dst"), F.lit("e").alias("label")).write.parquet(str(tmp_path / "e"))
    graph = PropertyGraph(spark, spark.read.parquet(str(tmp_path / "v")), spark.read.parquet(str(tmp_path / "e")))
    plan = lambda t: t.toDF()._jdf.queryExecution().executedPlan().toString()
    text = plan(graph.traversal().V().has("p", P.gte(3)))
    assert "GreaterThanOrEqual(p,3)" in text and "unused" not in text
    assert plan(graph.traversal().V(1).outE().inV()).count("Join") == 1
    assert "TakeOrderedAndProject" in plan(graph.traversal().V().order().by("p").limit(3))


def test_records_and_groups(coo6):
    coo6.set_vertex_properties("p", range(6), [5, 4, 3, 2, 1, 0])
    g = coo6.traversal()
    pairs = lambda t: sorted((r.key, r.value) for r in t.toList())
    assert g.V([0, 3]).project("a", "n").by("p").by(__().out().count()).toList() == [(5, 2), (2, 1)]
    assert pairs(g.V().group().by(__().out().count())) == [(1, [3, 4]), (2, [0, 1, 2, 5])]
    assert pairs(g.V().group().by(__().out().count()).by(__().count())) == [(1, 2), (2, 4)]
    assert pairs(g.V().group().by(__().out().count()).by(__().out().count())) == [(1, 2), (2, 8)]
    assert pairs(g.V([1, 1, 2]).group().by("p").by(__().values("p").sum())) == [(3, 3), (4, 8)]
    assert [r.p for r in g.V([4]).valueMap().toList()] == [1] and g.V([4]).valueMap("p").toList() == [(1,)]
    assert sorted(g.V().map(__().out().values("p").min()).toList()) == [0, 0, 1, 1, 1, 2]
    assert sorted(g.V([0, 1]).constant([7, 8]).unfold().toList()) == [7, 7, 8, 8]
    for wrong in (lambda: g.V().project("a").toList(), lambda: g.V().project("a").by("p").by("p"), lambda: g.V().group().toList(), lambda: g.V().out().drop(), lambda: g.V().unfold().toList()):
        with pytest.raises(ValueError):
            wrong()


def test_paths_and_tests(coo6):
    coo6.set_vertex_properties("p", range(6), [5, 4, 3, 2, 1, 0])
    g = coo6.traversal()
    assert sorted(g.V(0).repeat(__().out().simplePath()).times(3).toList()) == [2, 3, 3, 4, 4]
    assert sorted(g.V(0).out().out().out().out().simplePath().toList()) == [3, 3, 4, 5]
    assert sorted(g.V(0).bothE().bothV().simplePath().toList()) == sorted(x for x in g.V(0).bothE().bothV().toList() if x != 0)
    with pytest.raises(ValueError):
        g.V().filter(__().out().simplePath()).toList()
    assert sorted(g.V().values("p").is_(P.gte(3)).toList()) == [3, 4, 5] and g.V().id().is_(4).toList() == [4]
    assert sorted(g.V().or_(__().has("p", 5), __().has("p", 0), __().has("p", P.gte(5))).toList()) == [0, 5]
    assert sorted(g.V().and_(__().out(), __().has("p", P.lt(2))).toList()) == [4, 5]
    assert g.V().has("", "p", 3).toList() == [2] and g.V().has("none", "p", 3).toList() == []


def test_seeds_of_a_table(coo6):
    ids = coo6.spark.createDataFrame([(1,), (1,), (99,), (None,)], "x long")
    assert sorted(coo6.traversal().V(ids).out().toList()) == [2, 2, 4, 4]
    with pytest.raises(ValueError):
        coo6.traversal().V().V(ids)


def test_shared_branches(coo6):
    """Branches that begin alike give what each would by itself, in bags."""
    coo6.set_vertex_properties("p", range(6), [5, 4, 3, 2, 1, 0])
    g = coo6.traversal()
    start = lambda: g.V().order().by("p").limit(3)
    hop = lambda: __().out().order().by("p").limit(3)
    together = start().union([__().identity(), hop(), hop().in_(), hop().in_().out(), hop()]).toList()
    apart = [start().toList(), start().out().order().by("p").limit(3).toList(), start().out().order().by("p").limit(3).in_().toList(), start().out().order().by("p").limit(3).in_().out().toList(), start().out().order().by("p").limit(3).toList()]
    assert sorted(together) == sorted(x for own in apart for x in own)


def test_simple_paths_by_counts(coo6, monkeypatch):
    """The last hop of simple paths is no join of paths with neighbours, in any direction, over loops and parallel edges, whatever comes after."""
    from loomgraph.operators import expand

    monkeypatch.setattr(expand, "COPY_BLOCK", 2)
    monkeypatch.setattr(expand, "TASK_COPIES", 5)
    graph = PropertyGraph(coo6.spark, coo6.vertices, coo6.edges)
    graph.add_edges([0, 0, 3, 3, 4, 2], [1, 1, 3, 3, 0, 0], "extra")
    g, plain = graph.traversal(), graph.traversal().withoutStrategy("simple_hop")
    chains = [
        lambda g: g.V().out().in_().simplePath(),
        lambda g: g.V().both().simplePath(),
        lambda g: g.V().both().both().both().simplePath(),
        lambda g: g.V().out().simplePath().both().both().simplePath().in_(),
        lambda g: g.V([1, 1, 4]).repeat(__().both("extra").simplePath()).times(2),
        lambda g: g.V().bothE().bothV().out().simplePath(),
        lambda g: g.V().as_("a").out().both().simplePath().select("a"),
        lambda g: g.V().order().limit(3).both().both().simplePath().id(),
        lambda g: g.V().out("none").in_().simplePath(),
    ]
    for chain in chains:
        assert "SimpleHop" in chain(g).explain() and "SimpleHop" not in chain(plain).explain()
        assert sorted(chain(g).toList()) == sorted(chain(plain).toList())
    assert g.V().out().in_().simplePath().toDF().rdd.getNumPartitions() > 1


def test_few_traversers_deal_no_edges(spark):
    """What a limit bounds, and what comes of it, meets the edges where these are read."""
    ids = spark.range(3_000_000).select("id", F.lit("x").alias("label"), F.col("id").alias("p"))
    edges = ids.select((F.col("id") + 0).alias("id"), F.col("id").alias("src"), ((F.col("id") * 7 + 1) % 3_000_000).alias("dst"), "label")
    g = PropertyGraph(spark, ids, edges).traversal()
    chains = [
        ([8, 57, 106], lambda: g.V().limit(3).out().out()),
        ([57, 57, 106, 106], lambda: g.V([1, 2]).as_("a").union([__().out().as_("b")]).union([__().out(), __().select("b").out()])),
        ([8, 15], lambda: g.V().limit(3).out().has("p", P.gt(7))),
        ([57, 400], lambda: g.V().limit(2).repeat(__().out()).times(3).has("p", P.lt(500))),
    ]
    for want, chain in chains:
        df = chain().toDF()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan, plan
        assert sorted(r.cur for r in df.collect()) == want
