"""The language's queries over the star schema, one or more for each step, with the SQL that says the same.

``v`` and ``e`` in the SQL are the graph's vertices and edges, written out below as the loader makes them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import P, PropertyGraph
from . import anon as __
from .functions.scalars import joined_texts
from .functions.vectors import l2, mean_vector
from .operators.expand import degree
from .operators.fixpoint import components, reachable
from .operators.subgraph import coo
from .sources.readers import exploded_sentences, sentence_offsets
from .sources.star import EDGES, LINES, TURNS, VERTICES, conversations, star

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
V = {k: n << 40 for k, n in VERTICES.items()}
E = {k: n << 58 for k, n in EDGES.items()}

_LINES = f"SELECT *, l_orderkey * {LINES} + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS line FROM lineitem"
CTE = f"""
v AS MATERIALIZED (
  SELECT {V['region']} + r_regionkey AS id, 'region' AS label, r_name AS name, NULL::DOUBLE AS acctbal, NULL AS segment, NULL::DOUBLE AS price, NULL::INT AS size FROM region
  UNION ALL SELECT {V['nation']} + n_nationkey, 'nation', n_name, NULL, NULL, NULL, NULL FROM nation
  UNION ALL SELECT {V['customer']} + c_custkey, 'customer', c_name, c_acctbal, c_mktsegment, NULL, NULL FROM customer
  UNION ALL SELECT {V['supplier']} + s_suppkey, 'supplier', s_name, s_acctbal, NULL, NULL, NULL FROM supplier
  UNION ALL SELECT {V['part']} + p_partkey, 'part', p_name, NULL, NULL, p_retailprice, p_size FROM part
  UNION ALL SELECT {V['order']} + o_orderkey, 'order', NULL, NULL, NULL, o_totalprice, NULL FROM orders),
l AS ({_LINES}),
e AS MATERIALIZED (
  SELECT {E['in_region']} + n_nationkey AS id, {V['nation']} + n_nationkey AS src, {V['region']} + n_regionkey AS dst, 'in_region' AS label, NULL::DOUBLE AS quantity, NULL::TIMESTAMP AS time FROM nation
  UNION ALL SELECT {E['customer_in']} + c_custkey, {V['customer']} + c_custkey, {V['nation']} + c_nationkey, 'in_nation', NULL, NULL FROM customer
  UNION ALL SELECT {E['supplier_in']} + s_suppkey, {V['supplier']} + s_suppkey, {V['nation']} + s_nationkey, 'in_nation', NULL, NULL FROM supplier
  UNION ALL SELECT {E['placed']} + o_orderkey, {V['customer']} + o_custkey, {V['order']} + o_orderkey, 'placed', NULL, o_orderdate FROM orders
  UNION ALL SELECT {E['contains']} + line, {V['order']} + l_orderkey, {V['part']} + l_partkey, 'contains', l_quantity, l_shipdate FROM l
  UNION ALL SELECT {E['filled_by']} + line, {V['order']} + l_orderkey, {V['supplier']} + l_suppkey, 'filled_by', l_quantity, l_shipdate FROM l),
q AS (SELECT embedding::DOUBLE[] AS q0 FROM embeddings WHERE vec_id = 0),
q7 AS (SELECT embedding::DOUBLE[] AS q7 FROM embeddings WHERE vec_id = 7),
s AS (SELECT {V['customer']} + vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], q0) AS s0, list_cosine_similarity(embedding::DOUBLE[], q7) AS s7 FROM embeddings, q, q7)"""

_graphs: dict[tuple[str, str], PropertyGraph] = {}


def graph_of(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """A graph that a query may read; those that change it take one of their own."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _graphs:
        _graphs.clear()
        _graphs[key] = star(spark, sf_dir)
    return _graphs[key]


def vector_of(spark: SparkSession, sf_dir: str, k: int) -> list[float]:
    return list(spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(F.col("vec_id") == k).select("embedding").first()[0])


def query(name: str, sql: str | None, recursive: bool = False) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = f"WITH {'RECURSIVE ' if recursive else ''}{CTE.strip()}{',' if sql.lstrip().startswith('+') else ''}\n{sql.lstrip().removeprefix('+').strip()}"
        return f

    return keep


def walk(name: str, sql: str, chain: Callable, columns: dict[str, str] | None = None) -> None:
    """A query that is one chain from a traversal source; ``columns``: tags to result columns."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = columns or {"cur": "cur"}
        return chain(graph_of(spark, sf_dir).traversal()).toDF(list(own)).toDF(*own.values())

    query(name, sql)(run)


def _in(label: str, *keys: int) -> str:
    return ", ".join(str(V[label] + k) for k in keys)


# Scans and counts
walk("v_count", "SELECT count(*) AS cur FROM v", lambda g: g.V().count())
walk("e_count", "SELECT count(*) AS cur FROM e", lambda g: g.E().count())
walk("v_by_ids", f"SELECT id AS cur FROM v JOIN (SELECT unnest([{_in('customer', 1, 1, 5)}, {V['part'] + 3}, 7]) AS want) ON id = want", lambda g: g.V([V["customer"] + 1, V["customer"] + 1, V["customer"] + 5, V["part"] + 3, 7]))
walk("v_ids_then_has", f"SELECT id AS cur FROM v WHERE id IN ({_in('customer', *range(20))}) AND acctbal > 0", lambda g: g.V([V["customer"] + k for k in range(20)]).has("acctbal", P.gt(0)))
walk("v_limit", "SELECT id AS cur FROM v ORDER BY id LIMIT 40", lambda g: g.V().limit(40))
walk("e_scan_placed", "SELECT id AS cur FROM e WHERE label = 'placed'", lambda g: g.E().hasLabel("placed"))
walk("mid_v_cross", "SELECT b.id AS cur, a.id AS a FROM v a, v b WHERE a.label = 'region' AND b.id IN (" + _in("nation", 1, 2) + ")", lambda g: g.V().hasLabel("region").as_("a").V([V["nation"] + 1, V["nation"] + 2]), {"cur": "cur", "a": "a"})

# Filters
walk("has_eq", "SELECT id AS cur FROM v WHERE segment = 'BUILDING'", lambda g: g.V().has("segment", "BUILDING"))
walk("has_neq", "SELECT id AS cur FROM v WHERE segment <> 'BUILDING'", lambda g: g.V().has("segment", P.neq("BUILDING")))
walk("has_gte_and_lte", "SELECT id AS cur FROM v WHERE acctbal >= 100 AND acctbal <= 5000", lambda g: g.V().has("acctbal", P.gte(100)).has("acctbal", P.lte(5000)))
walk("has_gt_lt", "SELECT id AS cur FROM v WHERE size > 10 AND size < 20", lambda g: g.V().has("size", P.gt(10)).has("size", P.lt(20)))
walk("has_exists", "SELECT id AS cur FROM v WHERE acctbal IS NOT NULL", lambda g: g.V().has("acctbal"))
walk("has_not", "SELECT id AS cur FROM v WHERE name IS NULL", lambda g: g.V().hasNot("name"))
walk("has_label", "SELECT id AS cur FROM v WHERE label IN ('nation', 'region')", lambda g: g.V().hasLabel("nation", "region"))
walk("has_label_key", "SELECT id AS cur FROM v WHERE label = 'supplier' AND acctbal < 0", lambda g: g.V().hasLabel("supplier").has("acctbal", P.lt(0)))
walk("has_mid", "SELECT o.id AS cur FROM v c JOIN e ON c.id = src JOIN v o ON o.id = dst WHERE c.segment = 'BUILDING' AND e.label = 'placed' AND o.price > 100000", lambda g: g.V().has("segment", "BUILDING").out("placed").has("price", P.gt(100000)))
walk("filter_child", "SELECT id AS cur FROM v WHERE label = 'customer' AND id IN (SELECT src FROM e WHERE label = 'placed')", lambda g: g.V().hasLabel("customer").filter(__().out("placed")))
walk("filter_not_child", "SELECT id AS cur FROM v WHERE label = 'customer' AND id NOT IN (SELECT src FROM e WHERE label = 'placed')", lambda g: g.V().hasLabel("customer").not_(__().out("placed")))
walk("where_two_values", "SELECT src AS cur FROM e JOIN v ON v.id = dst WHERE e.label = 'contains' AND quantity > size", lambda g: g.V().hasLabel("order").as_("o").outE("contains").elementMap(["quantity"]).inV().elementMap(["size"]).where("quantity", P.gt("size")).select("o"))

# Values
walk("values_prop", "SELECT acctbal AS cur FROM v WHERE acctbal IS NOT NULL", lambda g: g.V().values("acctbal"))
walk("values_after_hop", "SELECT n.name AS cur FROM v s JOIN e ON s.id = src JOIN v n ON n.id = dst WHERE s.label = 'supplier' AND e.label = 'in_nation'", lambda g: g.V().hasLabel("supplier").out("in_nation").values("name"))
walk("id_and_label", "SELECT label AS cur FROM v", lambda g: g.V().label())
walk("constant_value", "SELECT 7 AS cur FROM v WHERE label = 'region'", lambda g: g.V().hasLabel("region").constant(7))
walk("identity_step", "SELECT id AS cur FROM v WHERE label = 'region'", lambda g: g.V().hasLabel("region").identity().id())

# Expansion
walk("out_placed", "SELECT dst AS cur FROM e JOIN v ON src = v.id WHERE e.label = 'placed' AND segment = 'BUILDING'", lambda g: g.V().has("segment", "BUILDING").out("placed"))
walk("in_filled_by", "SELECT src AS cur FROM e JOIN v ON dst = v.id WHERE e.label = 'filled_by' AND acctbal < 0", lambda g: g.V().hasLabel("supplier").has("acctbal", P.lt(0)).in_("filled_by"))
walk("out_all_labels", "SELECT dst AS cur FROM e JOIN v ON src = v.id WHERE v.label = 'nation'", lambda g: g.V().hasLabel("nation").out())
walk("both_nation", "SELECT dst AS cur FROM e JOIN v ON src = v.id WHERE v.label = 'nation' UNION ALL SELECT src FROM e JOIN v ON dst = v.id WHERE v.label = 'nation'", lambda g: g.V().hasLabel("nation").both())
walk("oute_ids", "SELECT e.id AS cur FROM e JOIN v ON src = v.id WHERE e.label = 'placed' AND acctbal > 9000", lambda g: g.V().hasLabel("customer").has("acctbal", P.gt(9000)).outE("placed"))
walk("ine_ids", "SELECT e.id AS cur FROM e JOIN v ON dst = v.id WHERE v.label = 'nation' AND e.label = 'in_nation'", lambda g: g.V().hasLabel("nation").inE("in_nation"))
walk("bothe_ids", "SELECT e.id AS cur FROM e JOIN v ON src = v.id WHERE v.label = 'nation' UNION ALL SELECT e.id FROM e JOIN v ON dst = v.id WHERE v.label = 'nation'", lambda g: g.V().hasLabel("nation").bothE())
walk("oute_inv", "SELECT dst AS cur FROM e WHERE label = 'contains' AND quantity >= 49", lambda g: g.V().hasLabel("order").outE("contains").has("quantity", P.gte(49)).inV())
walk("ine_outv", "SELECT src AS cur FROM e WHERE label = 'filled_by' AND quantity <= 2", lambda g: g.V().hasLabel("supplier").inE("filled_by").has("quantity", P.lte(2)).outV())
walk("bothv", "SELECT unnest([src, dst]) AS cur FROM e WHERE label = 'in_region'", lambda g: g.E().hasLabel("in_region").bothV())
walk("two_hop_count", "SELECT count(*) AS cur FROM e a JOIN e b ON a.dst = b.src WHERE a.label = 'placed' AND b.label = 'contains'", lambda g: g.V().hasLabel("customer").out("placed").out("contains").count())
walk("three_hop_bulk", "SELECT count(*) AS cur FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.dst WHERE a.label = 'placed' AND b.label = 'contains' AND c.label = 'contains'", lambda g: g.V().hasLabel("customer").out("placed").out("contains").in_("contains").count())

# Tags, unions, repeats
walk("as_select_path", "+ a AS MATERIALIZED (SELECT src, dst FROM e WHERE label = 'placed' AND src IN (SELECT id FROM v WHERE acctbal > 9900)), b AS MATERIALIZED (SELECT src, dst FROM e WHERE label = 'contains')\nSELECT b.dst AS cur, a.src AS c, a.dst AS o FROM a JOIN b ON a.dst = b.src", lambda g: g.V().hasLabel("customer").has("acctbal", P.gt(9900)).as_("c").out("placed").as_("o").out("contains"), {"cur": "cur", "c": "c", "o": "o"})
walk("select_tags", "SELECT a.src AS cur FROM e a WHERE a.label = 'placed'", lambda g: g.V().hasLabel("customer").as_("c").out("placed").select("c"))
walk("union_branches", "SELECT dst AS cur FROM e JOIN v ON src = v.id WHERE v.label = 'nation' UNION ALL SELECT src FROM e JOIN v ON dst = v.id WHERE v.label = 'nation' AND e.label = 'in_nation' UNION ALL SELECT id FROM v WHERE label = 'nation'", lambda g: g.V().hasLabel("nation").union([__().out(), __().in_("in_nation"), __().identity()]))
walk("union_then_select", "SELECT DISTINCT x AS cur FROM (SELECT dst AS x FROM e JOIN v ON src = v.id WHERE v.label = 'nation' UNION ALL SELECT src FROM e JOIN v ON dst = v.id WHERE v.label = 'nation' UNION ALL SELECT id FROM v WHERE label = 'nation')", lambda g: g.V().hasLabel("nation").as_("s").union([__().out().as_("h"), __().in_().as_("h")]).union([__().select("h"), __().select("s")]).dedup())
walk("repeat_times2", "+ a AS MATERIALIZED (SELECT dst FROM e WHERE src IN (SELECT id FROM v WHERE label = 'customer'))\nSELECT e.dst AS cur FROM a JOIN e ON a.dst = e.src", lambda g: g.V().hasLabel("customer").repeat(__().out()).times(2))
walk("repeat_emit", "SELECT id AS cur FROM v WHERE label = 'supplier' UNION ALL SELECT dst FROM e JOIN v ON src = v.id WHERE v.label = 'supplier' UNION ALL SELECT b.dst FROM e a JOIN e b ON a.dst = b.src JOIN v ON v.id = a.src WHERE v.label = 'supplier'", lambda g: g.V().hasLabel("supplier").emit(__().identity()).repeat(__().out()).times(2))
walk("dedup_out", "SELECT DISTINCT dst AS cur FROM e WHERE label = 'contains' AND quantity > 45", lambda g: g.E().hasLabel("contains").has("quantity", P.gt(45)).inV().dedup())
walk("dedup_tags", "SELECT dst AS cur, min(src) AS o FROM e WHERE label = 'contains' GROUP BY dst", lambda g: g.V().hasLabel("order").as_("o").out("contains").dedup(), {"cur": "cur", "o": "o"})
walk("distinct_count", "SELECT count(DISTINCT dst) AS cur FROM e WHERE label = 'filled_by'", lambda g: g.V().hasLabel("order").out("filled_by").dedup().count())


@query("repeat_until_empty", None)
def repeat_until_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each conversation's first turn through all that follow."""
    g = conversations(spark, sf_dir).traversal()
    return g.V().not_(__().in_()).emit(__().identity()).repeat(__().out("next")).toDF()


SQL["repeat_until_empty"] = f"SELECT DISTINCT {V['turn']} + conv_id * {TURNS} + turn AS cur FROM conversations"


@query("repeat_until_last", None)
def repeat_until_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = conversations(spark, sf_dir).traversal()
    return g.V().not_(__().in_()).repeat(__().out("next")).until(__().not_(__().out("next"))).toDF()


SQL["repeat_until_last"] = f"SELECT {V['turn']} + conv_id * {TURNS} + max(turn) AS cur FROM conversations GROUP BY conv_id"

# Order, limits, reductions
walk("order_plain", "SELECT id AS cur FROM v WHERE label = 'nation' ORDER BY id DESC LIMIT 5", lambda g: g.V().hasLabel("nation").order().by(__().id(), "DESC").limit(5))
walk("order_by_degree_desc", "SELECT id AS cur FROM v WHERE label = 'customer'", lambda g: g.V().hasLabel("customer").order().by(__().out("placed").count(), "DESC"))
walk("topk_by_degree", "SELECT v.id AS cur FROM v LEFT JOIN e ON src = v.id AND e.label = 'placed' WHERE v.label = 'customer' GROUP BY v.id ORDER BY count(e.id) DESC, v.id LIMIT 25", lambda g: g.V().hasLabel("customer").order().by(__().out("placed").count(), "DESC").limit(25))
walk("topk_by_degree_asc", "SELECT v.id AS cur FROM v LEFT JOIN e ON src = v.id AND e.label = 'placed' WHERE v.label = 'customer' GROUP BY v.id ORDER BY count(e.id), v.id LIMIT 25", lambda g: g.V().hasLabel("customer").order().by(__().out("placed").count()).limit(25))
walk("topk_by_property", "SELECT id AS cur FROM v WHERE label = 'order' ORDER BY price DESC, id LIMIT 30", lambda g: g.V().hasLabel("order").order().by("price", "DESC").limit(30))
walk("min_global", "SELECT min(acctbal) AS cur FROM v", lambda g: g.V().values("acctbal").min())
walk("max_global", "SELECT max(price) AS cur FROM v WHERE label = 'order'", lambda g: g.V().hasLabel("order").values("price").max())
walk("sum_sizes", "SELECT sum(size)::BIGINT AS cur FROM v", lambda g: g.V().values("size").sum())
walk("min_by_group", "SELECT min(e.id) AS cur, dst AS d FROM e WHERE label = 'placed' OR label = 'in_nation' GROUP BY dst, label", lambda g: g.E().has("label", P.within("placed", "in_nation")).elementMap(["dst", "label"]).min("dst"), {"cur": "cur", "dst": "d"})


@query("mean_sizes", "SELECT round(avg(size), 6) AS cur FROM v")
def mean_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = graph_of(spark, sf_dir).traversal().V().values("size").mean().toDF()
    return df.select(F.round("cur", 6).alias("cur"))


def child_values(name: str, sql: str, label: str, child: Callable) -> None:
    """``id, value``: a child's value for each vertex of a label, through an upserted property."""

    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        graph = star(spark, sf_dir)
        graph.traversal().V().hasLabel(label).property("value", child()).frame()
        return graph.vertices.where((F.col("label") == label) & F.col("value").isNotNull()).select("id", "value")


child_values("min_per_vertex", "SELECT src AS id, min(v.price) AS value FROM e JOIN v ON dst = v.id WHERE e.label = 'placed' GROUP BY src", "customer", lambda: __().out("placed").values("price").min())
child_values("count_per_vertex", "SELECT v.id, count(e.id) AS value FROM v LEFT JOIN e ON dst = v.id AND e.label = 'filled_by' WHERE v.label = 'supplier' GROUP BY v.id", "supplier", lambda: __().in_("filled_by").count())
child_values("max_two_hops", "SELECT a.src AS id, max(v.size) AS value FROM e a JOIN e b ON a.dst = b.src JOIN v ON b.dst = v.id WHERE a.label = 'placed' AND b.label = 'contains' GROUP BY a.src", "customer", lambda: __().out("placed").out("contains").values("size").max())


def _degree(name: str, label: str, labels: tuple[str, ...], direction: str, sql: str) -> None:
    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        graph = graph_of(spark, sf_dir)
        return degree(graph, labels, direction, graph.vertices.where(F.col("label") == label).select("id"))


_degree("degree_out", "customer", ("placed",), "out", "SELECT v.id, count(e.id) AS degree FROM v LEFT JOIN e ON src = v.id AND e.label = 'placed' WHERE v.label = 'customer' GROUP BY v.id")
_degree("degree_in", "part", (), "in", "SELECT v.id, count(e.id) AS degree FROM v LEFT JOIN e ON dst = v.id WHERE v.label = 'part' GROUP BY v.id")
_degree("degree_both", "nation", (), "both", "SELECT v.id, count(x.id) AS degree FROM v LEFT JOIN (SELECT id, src AS at FROM e UNION ALL SELECT id, dst FROM e) x ON x.at = v.id WHERE v.label = 'nation' GROUP BY v.id")

FLAGSHIP = """+
n AS MATERIALIZED (SELECT dst, count(*) AS n FROM e WHERE label = 'contains' GROUP BY dst),
p AS MATERIALIZED (SELECT v.id FROM v LEFT JOIN n ON n.dst = v.id WHERE v.label = 'part' AND v.size >= 10 AND v.price >= 950 ORDER BY coalesce(n, 0), v.id LIMIT 500),
a AS MATERIALIZED (SELECT e.src FROM e JOIN p ON e.dst = p.id WHERE e.label = 'contains'),
c AS MATERIALIZED (SELECT src, dst FROM e WHERE label = 'filled_by')
SELECT c.dst AS cur FROM a JOIN c ON c.src = a.src"""
walk("filter_degree_expand", FLAGSHIP, lambda g: g.V().hasLabel("part").has("size", P.gte(10)).has("price", P.gte(950)).order().by(__().in_("contains").count()).limit(500).in_("contains").out("filled_by"))
walk("filter_order_repeat", """+
n AS MATERIALIZED (SELECT src, count(*) AS n FROM e GROUP BY src),
p AS MATERIALIZED (SELECT v.id FROM v LEFT JOIN n ON n.src = v.id WHERE v.label = 'customer' AND acctbal >= 1000 ORDER BY coalesce(n, 0), v.id LIMIT 200),
a AS MATERIALIZED (SELECT e.dst FROM e JOIN p ON e.src = p.id)
SELECT e.dst AS cur FROM a JOIN e ON e.src = a.dst""", lambda g: g.V().hasLabel("customer").has("acctbal", P.gte(1000)).order().by(__().out().count()).limit(200).repeat(__().out()).times(2))


# Vectors
def vector_walk(name: str, sql: str, chain: Callable, columns: dict[str, str] | None = None, digits: str | None = None) -> None:
    """As ``walk``; the chain also gets the query vectors of customers 0 and 7."""

    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = columns or {"cur": "cur"}
        t = chain(graph_of(spark, sf_dir).traversal(), [vector_of(spark, sf_dir, 0)], [vector_of(spark, sf_dir, 7)])
        df = t.toDF(list(own)).toDF(*own.values())
        return df.withColumn(digits, F.round(digits, 6)) if digits else df


vector_walk("similarity_scores", "SELECT id, round(s0, 6) AS score FROM s", lambda g, a, b: g.V().hasLabel("customer").as_("v").similarity("emb", a), {"v": "id", "cur": "score"}, "score")
vector_walk("similarity_multi", "SELECT id, round(greatest(s0, s7), 6) AS score FROM s", lambda g, a, b: g.V().hasLabel("customer").as_("v").similarity("emb", a + b), {"v": "id", "cur": "score"}, "score")
vector_walk("like_threshold", "SELECT id AS cur FROM s WHERE s0 >= 0.2", lambda g, a, b: g.V().like("emb", a, 0.2))
vector_walk("like_topk", "SELECT id AS cur FROM s ORDER BY s0 DESC, id LIMIT 10", lambda g, a, b: g.V().like("emb", a, 10))
vector_walk("like_zero", "SELECT id AS cur FROM s WHERE false", lambda g, a, b: g.V().like("emb", a, 0))
vector_walk("like_multi_query", "SELECT id AS cur FROM (SELECT id, 0 AS q, s0 AS s FROM s UNION ALL SELECT id, 1, s7 FROM s) ORDER BY s DESC, id, q LIMIT 15", lambda g, a, b: g.V().like("emb", a + b, 15))
vector_walk("like_then_has", "SELECT k.id AS cur FROM (SELECT id FROM s ORDER BY s0 DESC, id LIMIT 40) k JOIN v USING (id) WHERE segment = 'BUILDING'", lambda g, a, b: g.V().like("emb", a, 40).has("segment", "BUILDING"))
vector_walk("has_then_like", "SELECT s.id AS cur FROM s JOIN v USING (id) WHERE segment = 'BUILDING' ORDER BY s0 DESC, s.id LIMIT 40", lambda g, a, b: g.V().has("segment", "BUILDING").like("emb", a, 40))
vector_walk("like_twice", "SELECT id AS cur FROM s WHERE s0 >= 0.05 ORDER BY s7 DESC, id LIMIT 12", lambda g, a, b: g.V().like("emb", a, 0.05).like("emb", b, 12))
vector_walk("like_dot", "SELECT id AS cur FROM (SELECT " + str(V["customer"]) + " + vec_id AS id, list_dot_product(embedding::DOUBLE[], q0) AS d FROM embeddings, q) WHERE round(d, 6) >= 0.3", lambda g, a, b: g.V().like("emb", a, 0.2999995, metric="dot"))
vector_walk("like_l2", "SELECT id AS cur FROM (SELECT " + str(V["customer"]) + " + vec_id AS id, list_distance(embedding::DOUBLE[], q0) AS d FROM embeddings, q) ORDER BY d, id LIMIT 10", lambda g, a, b: g.V().like("emb", a, 10, metric="l2"))
vector_walk("knn_out_expand", "SELECT dst AS cur FROM (SELECT id FROM s ORDER BY s0 DESC, id LIMIT 20) k JOIN e ON src = k.id AND label = 'placed'", lambda g, a, b: g.V().like("emb", a, 20).out("placed"))
vector_walk("order_by_similarity", "SELECT id AS cur FROM s ORDER BY s0 DESC, id LIMIT 10", lambda g, a, b: g.V().hasLabel("customer").filter(__().encode("emb")).order().by(__().similarity("emb", a), "DESC").limit(10))

#: Seeds by similarity, their nations' customers ranked by similarity, and those customers' orders by price.
_RAG = """+
seed AS (SELECT id FROM s ORDER BY s0 DESC, id LIMIT 3),
h0 AS (SELECT src AS id FROM e JOIN (SELECT dst AS n FROM e JOIN seed ON src = seed.id WHERE label = 'in_nation') ON dst = n JOIN s ON s.id = src WHERE label = 'in_nation' ORDER BY s0 DESC, src LIMIT 8),
h1 AS (SELECT e.id AS edge, dst AS id FROM e JOIN h0 ON src = h0.id JOIN v ON v.id = dst WHERE e.label = 'placed' ORDER BY price DESC, dst, {order} LIMIT 12)
"""


vector_walk("rag_retrieve_vertices", _RAG.format(order="dst") + "SELECT DISTINCT id AS cur FROM (SELECT id FROM seed UNION ALL SELECT id FROM h0 UNION ALL SELECT id FROM h1)", lambda g, a, b: g.V().like("emb", a, 3).union([__().identity(), __().out("in_nation").in_("in_nation").filter(__().encode("emb")).order().by(__().similarity("emb", a), "DESC").limit(8), __().out("in_nation").in_("in_nation").filter(__().encode("emb")).order().by(__().similarity("emb", a), "DESC").limit(8).out("placed").order().by("price", "DESC").limit(12)]).dedup())
vector_walk("rag_tagged_hops", """+
seed AS (SELECT id FROM s ORDER BY s0 DESC, id LIMIT 3),
h0 AS (SELECT dst AS id, seed.id AS sid FROM e JOIN seed ON src = seed.id WHERE label = 'placed'),
h1 AS (SELECT dst AS id FROM e JOIN h0 ON src = h0.id WHERE label = 'contains')
SELECT DISTINCT id AS cur FROM (SELECT id FROM h1 UNION ALL SELECT h0.id FROM h0 JOIN e ON src = h0.id AND label = 'contains' UNION ALL SELECT sid FROM h0 JOIN e ON src = h0.id AND label = 'contains')""", lambda g, a, b: g.V().like("emb", a, 3).as_("s").union([__().out("placed").as_("h0")]).union([__().out("contains").as_("h1")]).union([__().select("h0"), __().select("h1"), __().select("s")]).dedup())
vector_walk("rag_retrieve_edges", """+
seed AS (SELECT id FROM s ORDER BY s0 DESC, id LIMIT 3),
h0 AS (SELECT e.id AS edge, dst AS id FROM e JOIN seed ON src = seed.id JOIN v ON v.id = dst WHERE e.label = 'placed' ORDER BY price DESC, e.id LIMIT 6),
h1 AS (SELECT e.id AS edge, h0.edge AS before FROM e JOIN h0 ON src = h0.id WHERE e.label = 'contains')
SELECT DISTINCT edge AS cur FROM (SELECT edge FROM h1 UNION ALL SELECT before FROM h1)""", lambda g, a, b: g.V().like("emb", a, 3).union([__().outE("placed").order().by(__().inV().values("price"), "DESC").limit(6).as_("h0").inV()]).union([__().outE("contains").as_("h1").inV()]).union([__().select("h0"), __().select("h1")]).dedup())


@query("encode_mean", "SELECT place - 1 AS place, round(avg(x), 6) AS x FROM (SELECT unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS place FROM embeddings) GROUP BY place")
def encode_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = mean_vector(graph_of(spark, sf_dir).traversal().V().hasLabel("customer").encode("emb").toDF(), "cur")
    return df.select(F.posexplode("vec").alias("place", "x")).select(F.col("place").cast("long").alias("place"), F.round("x", 6).alias("x"))


@query("encode_distance", "+ m AS (SELECT i, avg(x) FILTER (segment = 'BUILDING') AS a, avg(x) FILTER (segment <> 'BUILDING') AS b FROM (SELECT segment, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings JOIN v ON v.id = vec_id + " + str(V["customer"]) + ") GROUP BY i)\nSELECT round(sqrt(sum((a - b) * (a - b))), 6) AS distance FROM m")
def encode_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between the means of two groups that have all vectors between them."""
    g = graph_of(spark, sf_dir).traversal()
    mean = lambda test, name: mean_vector(g.V().has("segment", test).encode("emb").toDF(), "cur", name)
    return mean(P.eq("BUILDING"), "a").crossJoin(mean(P.neq("BUILDING"), "b")).select(F.round(l2(F.col("a"), F.col("b")), 6).alias("distance"))


# Subgraphs
_EDGES = "e.label = 'placed' AND v.acctbal > 9900"


def _rich(spark: SparkSession, sf_dir: str) -> tuple[PropertyGraph, DataFrame]:
    graph = graph_of(spark, sf_dir)
    return graph, graph.traversal().V().hasLabel("customer").has("acctbal", P.gt(9900)).outE("placed").toDF()


_COO = f"+ g AS (SELECT e.id, src, dst FROM e JOIN v ON src = v.id WHERE {_EDGES}), p AS (SELECT vid, row_number() OVER (ORDER BY vid) - 1 AS place FROM (SELECT DISTINCT unnest([src, dst]) AS vid FROM g))\n"


@query("subgraph_vid", _COO + "SELECT place, vid FROM p")
def subgraph_vid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coo(*_rich(spark, sf_dir))[0]


@query("subgraph_coo", _COO + "SELECT g.id AS edge, a.place AS src, b.place AS dst FROM g JOIN p a ON a.vid = g.src JOIN p b ON b.vid = g.dst")
def subgraph_coo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coo(*_rich(spark, sf_dir))[1]


@query("subgraph_graph", _COO + "SELECT 'vertex' AS what, place AS id, '' AS label, vid AS original_id FROM p UNION ALL SELECT 'edge', row_number() OVER (ORDER BY id) - 1, 'retrieved_edge', id FROM g")
def subgraph_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, edges = _rich(spark, sf_dir)
    own = graph.subgraph(edges)
    parts = [df.select(F.lit(what).alias("what"), "id", "label", "original_id") for what, df in (("vertex", own.vertices), ("edge", own.edges))]
    return parts[0].unionByName(parts[1])


# Fixed points
_PLACED = "SELECT src, dst FROM e WHERE label = 'placed' UNION ALL SELECT dst, src FROM e WHERE label = 'placed'"
_COMPONENTS = f"""+
b AS ({_PLACED}),
c(id, component) USING KEY (id) AS (
  SELECT id, id FROM v
  UNION
  SELECT b.dst, min(c.component) FROM c JOIN b ON b.src = c.id JOIN recurring.c r ON r.id = b.dst WHERE c.component < r.component GROUP BY b.dst)
"""


@query("components", _COMPONENTS + "SELECT id, component FROM c", recursive=True)
def components_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(graph_of(spark, sf_dir), ["placed"])


@query("component_count", _COMPONENTS + "SELECT count(DISTINCT component) AS n FROM c", recursive=True)
def component_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(graph_of(spark, sf_dir), ["placed"]).agg(F.count_distinct("component").alias("n"))


_END = "TIMESTAMP '1996-06-30'"
_REACH = f"""+
t AS (SELECT src, dst, time FROM e WHERE label IN ('placed', 'contains') AND time <= {_END}),
r(id, last_time) USING KEY (id) AS (
  SELECT id, TIMESTAMP '1994-01-01' FROM v WHERE segment = 'BUILDING'
  UNION
  SELECT t.dst, min(t.time) FROM r JOIN t ON t.src = r.id LEFT JOIN recurring.r k ON k.id = t.dst WHERE t.time > r.last_time AND (k.id IS NULL OR t.time < k.last_time) GROUP BY t.dst)
"""


def _reach(mode: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        graph = graph_of(spark, sf_dir)
        starts = graph.traversal().V().has("segment", "BUILDING").toDF()
        at = lambda s: F.lit(s).cast("timestamp_ntz")
        return reachable(graph, starts, at("1994-01-01 00:00:00"), at("1996-06-30 00:00:00"), labels=["placed", "contains"], mode=mode)

    return run


query("temporal_reach_exact", _REACH + "SELECT id, last_time FROM r", recursive=True)(_reach("exact"))
query(
    "temporal_reach_greedy",
    f"""+
t AS (SELECT src, dst, time FROM e WHERE label IN ('placed', 'contains') AND time <= {_END}),
r0 AS (SELECT id, TIMESTAMP '1994-01-01' AS last_time FROM v WHERE segment = 'BUILDING'),
r1 AS (SELECT dst AS id, min(time) AS last_time FROM r0 JOIN t ON src = id WHERE time > last_time AND dst NOT IN (SELECT id FROM r0) GROUP BY dst),
r2 AS (SELECT dst AS id, min(time) AS last_time FROM r1 JOIN t ON src = id WHERE time > last_time AND dst NOT IN (SELECT id FROM r0) AND dst NOT IN (SELECT id FROM r1) GROUP BY dst)
SELECT * FROM r0 UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM r2""",
)(_reach("greedy"))


# Changes
@query("upsert_property", "SELECT id, CASE WHEN segment = 'BUILDING' THEN 1.5 ELSE acctbal END AS acctbal FROM v WHERE label = 'customer'")
def upsert_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = star(spark, sf_dir)
    graph.traversal().V().has("segment", "BUILDING").property("acctbal", 1.5).frame()
    return graph.vertices.where("label = 'customer'").select("id", "acctbal")


@query("scatter_embeddings", f"SELECT v.id, coalesce(round(x.embedding[1]::DOUBLE, 6), -1) AS first FROM v LEFT JOIN embeddings x ON v.id = {V['customer']} + x.vec_id AND v.segment = 'BUILDING' WHERE v.label = 'customer'")
def scatter_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors for the customers of one segment; all others get the default."""
    graph = star(spark, sf_dir)
    graph.vertices = graph.vertices.where("label = 'customer'")
    own = graph.traversal().V().has("segment", "BUILDING").toDF()
    graph.set_vertex_embeddings("new", graph.embedding("emb").join(own, F.col("id") == F.col("cur"), "left_semi"), default=-1.0)
    return graph.embedding("new").select("id", F.round(F.col("vec")[0].cast("double"), 6).alias("first"))


@query("added_edges", f"""+ top AS (SELECT max(id) AS t FROM v), te AS (SELECT max(id) AS t FROM e)
SELECT src, dst, id > te.t AS added FROM e, te WHERE label = 'in_region' UNION ALL SELECT t + 1, {V['region']}, true FROM top UNION ALL SELECT t + 2, {V['region'] + 1}, true FROM top UNION ALL SELECT t + 2, t + 1, true FROM top""")
def added_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = star(spark, sf_dir)
    new = graph.add_vertices(2, "place")
    ids = graph.add_edges([new[0], new[1], new[1]], [V["region"], V["region"] + 1, new[0]], "in_region")
    return graph.edges.where("label = 'in_region'").select("src", "dst", (F.col("id") >= ids[0]).alias("added"))


@query("property_entries", "SELECT 'acctbal' AS property, count(acctbal) AS n FROM v UNION ALL SELECT 'size', count(size) FROM v UNION ALL SELECT 'quantity', count(quantity) FROM e")
def property_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = graph_of(spark, sf_dir)
    own = [(k, graph.vertex_property_entries(k)) for k in ("acctbal", "size")] + [("quantity", graph.edge_property_entries("quantity"))]
    return spark.createDataFrame(own, "property string, n long")


# Samples: their size and where they come from, as no SQL draws the same
@query("sample_size", "SELECT 60 AS n, true AS inside")
def sample_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = graph_of(spark, sf_dir)
    drawn = graph.traversal().V().hasLabel("order").sample(60, seed=4).toDF()
    return drawn.join(graph.vertices.where("label = 'order'"), F.col("cur") == F.col("id"), "left").agg(F.count_distinct("cur").cast("int").alias("n"), F.every(F.col("id").isNotNull()).alias("inside"))


@query("random_walk_size", "SELECT 10 AS n")
def random_walk_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled customers, ten of their edges tagged with a batch, then the edges of that batch."""
    graph = star(spark, sf_dir)
    graph.traversal().V().hasLabel("customer").sample(62).repeat(__().outE("placed").sample(10).property("batch", 0).inV()).times(1).frame()
    return graph.traversal().E().has("batch", 0).count().toDF().select(F.col("cur").cast("int").alias("n"))


# Text and arrays, as retrieval's loaders and prompts use them
@query("explode_offsets", "+ w AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), o AS (SELECT doc_id, lines, sum(greatest(len(lines), 1)) OVER (ORDER BY doc_id) - greatest(len(lines), 1) AS off FROM w)\nSELECT doc_id AS article, (off + p - 1)::BIGINT AS vertex, md5(lines[p]) AS sentence FROM (SELECT *, unnest(generate_series(1, len(lines))) AS p FROM o)")
def explode_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("article"), F.split("text", "\n").alias("sentences"))
    own = exploded_sentences(docs).join(sentence_offsets(docs), "article")
    return own.select("article", (F.col("offset") + F.col("place")).alias("vertex"), F.md5("sentence").alias("sentence"))


@query("context_by_group", "SELECT conv_id, string_agg(coalesce(text, ''), ' ' ORDER BY turn, text) AS context FROM conversations GROUP BY conv_id")
def context_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined_texts(spark.read.parquet(f"{sf_dir}/conversations.parquet"), ["conv_id"], "text", ["turn"])


@query("group_by_label", "SELECT label, count(*) AS n, min(id) AS low FROM v GROUP BY label")
def group_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = lambda child: graph_of(spark, sf_dir).traversal().V().group().by(__().label()).by(child).toDF()
    n = grouped(__().count()).select("cur.key", F.col("cur.value").alias("n"))
    return n.join(grouped(__().id().min()).select("cur.key", F.col("cur.value").alias("low")), "key").select(F.col("key").alias("label"), "n", "low")
