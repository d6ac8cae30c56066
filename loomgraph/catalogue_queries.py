"""Queries of the catalogue, of readers and writers, and of records and groups, with the SQL that says the same.

They go into the same tables of queries as those of ``queries``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import P
from . import anon as __
from .functions.scalars import day_number, first_item, joined_texts, part_key, prompt, words
from .graph import PropertyGraph
from .operators.sampling import drawn_settings, split
from .operators.subgraph import edge_index
from .operators.vector import CellIndex, nearest_each
from .queries import LINES, E, V, _EDGES, _rich, graph_of, query, vector_of, walk
from .sources.readers import csv_tables, edge_list, flights, from_arrays, wiki
from .sources.star import star
from .sources.writers import json_lines, write_csv, write_text_vectors
from .storage import written_path

_TOP = "+ top AS (SELECT max(id) AS t FROM v), te AS (SELECT max(id) AS t FROM e)\n"


def _nation(k: int) -> int:
    return V["nation"] + k


# The catalogue
@query("added_elements", _TOP + f"SELECT te.t + 1 AS id, top.t + 1 AS src, {_nation(0)}::BIGINT AS dst, 'depot' AS kind FROM top, te UNION ALL SELECT te.t + 2, top.t + 2, {_nation(1)}::BIGINT, 'store' FROM top, te")
def added_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices and edges one by one, by the graph and by the language; each edge with its source's label."""
    graph = star(spark, sf_dir)
    g = graph.traversal()
    depot, store = graph.add_vertex("depot"), g.addV("store").next()
    graph.add_edge(depot, _nation(0), "serves")
    g.addE("serves").from_(store).to(__().V(_nation(1))).iterate()
    edges = graph.edges.where("label = 'serves'").select("id", "src", "dst")
    return edges.join(graph.vertices.select(F.col("id").alias("src"), F.col("label").alias("kind")), "src").select("id", "src", "dst", "kind")


@query("declared_properties", "SELECT v.id, (v.id % 3)::INT AS rank, count(e.id) FILTER (e.id % 2 = 0) AS even FROM v LEFT JOIN e ON e.dst = v.id AND e.label = 'in_region' WHERE v.label = 'region' GROUP BY v.id")
def declared_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = star(spark, sf_dir)
    graph.declare_vertex_property("rank", "int32")
    graph.declare_edge_property("even", "boolean")
    graph.set_vertex_properties("rank", graph.vertices.where("label = 'region'").select("id", (F.col("id") % 3).cast("int")))
    graph.set_edge_properties("even", graph.edges.where("label = 'in_region' AND id % 2 = 0").select("id", F.lit(True)))
    even = graph.view_edge_property("even").join(graph.edges.select("id", "dst"), "id").groupBy("dst").agg(F.count(F.lit(1)).alias("even"))
    ranks = graph.view_vertex_property("rank").withColumnRenamed("value", "rank")
    return ranks.join(even, F.col("id") == F.col("dst"), "left").select("id", "rank", F.coalesce("even", F.lit(0).cast("long")).alias("even"))


_ASKED = [V["customer"] + 9, V["customer"] + 2, V["region"], V["customer"] + 9, V["supplier"] + 4]
_PLACES = "(SELECT unnest(range(0, {n})) AS place, unnest([{ids}]) AS id)"


@query("properties_of_ids", f"SELECT place, id, acctbal AS value FROM {_PLACES.format(n=len(_ASKED), ids=', '.join(map(str, _ASKED)))} JOIN v USING (id) WHERE acctbal IS NOT NULL")
def properties_of_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_of(spark, sf_dir).get_vertex_properties("acctbal", _ASKED)


_LINES_ASKED = [E["contains"] + k * LINES for k in (3, 1, 2)]


@query("edge_properties_of_ids", f"SELECT place, id, quantity AS value FROM {_PLACES.format(n=3, ids=', '.join(map(str, _LINES_ASKED)))} JOIN e USING (id) WHERE quantity IS NOT NULL")
def edge_properties_of_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_of(spark, sf_dir).get_edge_properties("quantity", _LINES_ASKED)


@query("property_views", "SELECT id, acctbal AS value, (SELECT count(acctbal) FROM v) AS entries FROM v WHERE acctbal IS NOT NULL")
def property_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = graph_of(spark, sf_dir)
    return graph.view_vertex_property("acctbal").withColumn("entries", F.lit(graph.vertex_property_entries("acctbal")).cast("long"))


@query("labels_of_ids", f"SELECT place, id, label FROM {_PLACES.format(n=len(_ASKED), ids=', '.join(map(str, _ASKED)))} JOIN v USING (id) UNION ALL SELECT place, id, label FROM {_PLACES.format(n=3, ids=', '.join(map(str, _LINES_ASKED)))} JOIN e USING (id)")
def labels_of_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = graph_of(spark, sf_dir)
    return graph.vertex_labels(_ASKED).unionByName(graph.edge_labels(_LINES_ASKED))


#: Types as the star's loader has them (fixed values).
_TYPES = {"vertex.id": "bigint", "vertex.label": "string", "vertex.acctbal": "double", "vertex.size": "int", "edge.src": "bigint", "edge.quantity": "double", "edge.time": "timestamp_ntz"}


@query("types_of_properties", "SELECT unnest([" + ", ".join(f"'{k}'" for k in _TYPES) + "]) AS name, unnest([" + ", ".join(f"'{t}'" for t in _TYPES.values()) + "]) AS type")
def types_of_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = graph_of(spark, sf_dir)
    named = {"vertex.id", "vertex.label", "edge.src"} | {f"vertex.{n}" for n in graph.vertex_property_names()} | {f"edge.{n}" for n in graph.edge_property_names()}
    return spark.createDataFrame([(k, t.simpleString()) for k, t in graph.types().items() if k in _TYPES and k in named], "name string, type string")


@query("embeddings_by_range", f"+ r AS (SELECT id, CASE WHEN id = {V['region'] + 1} THEN [1.5, 2.5] WHEN id = {V['region'] + 2} THEN [3.5, 4.5] ELSE [-1.0, -1.0] END AS vec FROM v WHERE label = 'region')\nSELECT place, id, vec[1]::DOUBLE AS x, vec[2]::DOUBLE AS y FROM {_PLACES.format(n=3, ids=f'''{V['region'] + 2}, {V['region']}, {V['region'] + 1}''')} JOIN r USING (id)")
def embeddings_by_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = star(spark, sf_dir)
    graph.set_vertex_embeddings_range("pair", V["region"] + 1, V["region"] + 2, [[1.5, 2.5], [3.5, 4.5]], default=-1.0)
    rows = graph.get_vertex_embeddings("pair", [V["region"] + 2, V["region"], V["region"] + 1])
    return rows.select("place", "id", F.col("vec")[0].cast("double").alias("x"), F.col("vec")[1].cast("double").alias("y"))


# Further steps
@query("seeds_of_a_table", f"SELECT dst AS cur FROM nation JOIN e ON src = {V['nation']} + n_regionkey")
def seeds_of_a_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.lit(V["nation"]) + F.col("n_regionkey"))
    return graph_of(spark, sf_dir).traversal().V(seeds).out().toDF()


walk("has_label_key_value", "SELECT id AS cur FROM v WHERE label = 'customer' AND segment = 'BUILDING'", lambda g: g.V().has("customer", "segment", "BUILDING"))
walk("is_value", "SELECT size AS cur FROM v WHERE size > 40", lambda g: g.V().values("size").is_(P.gt(40)))
walk("or_children", "SELECT id AS cur FROM v WHERE label = 'part' AND (size < 5 OR price > 1800)", lambda g: g.V().hasLabel("part").or_(__().has("size", P.lt(5)), __().has("price", P.gt(1800))))
walk("and_children", "SELECT id AS cur FROM v WHERE label = 'customer' AND acctbal > 0 AND id IN (SELECT src FROM e WHERE label = 'placed')", lambda g: g.V().hasLabel("customer").and_(__().has("acctbal", P.gt(0)), __().out("placed")))
walk(
    "simple_path",
    "SELECT c.dst AS cur FROM e a JOIN e b ON a.dst = b.dst AND a.label = b.label JOIN e c ON c.src = b.src WHERE a.label = 'in_nation' AND c.label = 'in_nation' AND a.src <> b.src AND c.dst <> a.dst UNION ALL SELECT b.src FROM e a JOIN e b ON a.dst = b.dst AND a.label = b.label JOIN v ON v.id = a.src WHERE v.label = 'supplier' AND a.label = 'in_nation' AND a.src <> b.src",
    lambda g: g.V().hasLabel("supplier").out("in_nation").in_("in_nation").simplePath(),
)
walk("map_child", "SELECT max(o.price) AS cur FROM e JOIN v o ON o.id = e.dst WHERE e.label = 'placed' GROUP BY e.src", lambda g: g.V().hasLabel("customer").map(__().out("placed").values("price").max()))
walk("unfold_lists", "SELECT unnest(range(0, 2)) AS cur FROM v WHERE label = 'region'", lambda g: g.V().hasLabel("region").constant([0, 1]).unfold())


@query("project_records", "SELECT c.name AS name, count(e.id) AS orders FROM v c LEFT JOIN e ON e.src = c.id AND e.label = 'placed' WHERE c.label = 'customer' GROUP BY c.id, c.name")
def project_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = graph_of(spark, sf_dir).traversal().V().hasLabel("customer").project("name", "orders").by("name").by(__().out("placed").count())
    return t.toDF().select("cur.name", "cur.orders")


@query("value_map", "SELECT name, size, price FROM v WHERE label = 'part'")
def value_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_of(spark, sf_dir).traversal().V().hasLabel("part").valueMap("name", "size", "price").toDF().select("cur.*")


@query("group_counts", "SELECT segment AS key, count(*) AS value FROM v WHERE label = 'customer' GROUP BY segment")
def group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_of(spark, sf_dir).traversal().V().hasLabel("customer").group().by("segment").by(__().count()).toDF().select("cur.*")


@query("group_sums", "SELECT o.status AS key, round(sum(e.quantity), 4) AS value FROM e JOIN (SELECT " + str(V["order"]) + " + o_orderkey AS id, o_orderstatus AS status FROM orders) o ON o.id = e.src WHERE e.label = 'contains' GROUP BY o.status")
def group_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = graph_of(spark, sf_dir).traversal().V().hasLabel("order").group().by("status").by(__().outE("contains").values("quantity").sum())
    return done.toDF().select("cur.key", F.round("cur.value", 4).alias("value"))


@query("group_lists", "SELECT size AS key, count(*) AS n, min(id) AS low, max(id) AS high FROM v WHERE label = 'part' GROUP BY size")
def group_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = graph_of(spark, sf_dir).traversal().V().hasLabel("part").group().by("size").toDF().select("cur.*")
    return done.select("key", F.size("value").cast("long").alias("n"), F.element_at("value", 1).alias("low"), F.element_at("value", -1).alias("high"))


@query("dropped_property", "SELECT id, CASE WHEN segment = 'BUILDING' THEN NULL ELSE acctbal END AS acctbal FROM v WHERE label = 'customer'")
def dropped_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = star(spark, sf_dir)
    graph.traversal().V().has("segment", "BUILDING").properties("acctbal").drop().iterate()
    return graph.vertices.where("label = 'customer'").select("id", "acctbal")


@query("order_with_places", "SELECT row_number() OVER (ORDER BY name DESC, id) - 1 AS place, id AS cur FROM v WHERE label = 'supplier'")
def order_with_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which results come."""
    t = graph_of(spark, sf_dir).traversal().V().hasLabel("supplier").order().by("name", "DESC")
    return spark.createDataFrame(list(enumerate(t.toList())), "place long, cur long")


@query("values_with_places", "SELECT row_number() OVER (ORDER BY size) - 1 AS place, size AS cur FROM v WHERE label = 'part'")
def values_with_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(graph_of(spark, sf_dir).traversal().V().values("size").order().toList())), "place long, cur int")


_TWICE = "SELECT b.dst AS cur FROM (SELECT v.id FROM v LEFT JOIN e ON src = v.id WHERE v.label = 'customer' AND acctbal >= 9000 GROUP BY v.id ORDER BY count(e.id), v.id LIMIT 20) p JOIN e a ON a.src = p.id JOIN e b ON b.src = a.dst"
walk("without_strategies", _TWICE, lambda g: g.withoutStrategy("fuse_filters", "unroll_repeat", "degree_pattern").V().hasLabel("customer").has("acctbal", P.gte(9000)).order().by(__().out().count()).limit(20).repeat(__().out()).times(2))
walk("with_strategies", _TWICE, lambda g: g.withoutStrategy("unroll_repeat").withStrategy("unroll_repeat").withAdminOption("note", "kept").V().hasLabel("customer").has("acctbal", P.gte(9000)).order().by(__().out().count()).limit(20).repeat(__().out()).times(2))


@query("explained_steps", None)
def explained_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rewritten steps of a chain; SQL has no word for them."""
    t = graph_of(spark, sf_dir).traversal().V().hasLabel("part").has("size", P.gte(10)).order().by(__().in_("contains").count()).limit(5)
    return spark.createDataFrame([tuple(line.split(": ", 1)) for line in t.explain().splitlines()], "place string, step string")


@query("iterated_results", "SELECT 'list' AS how, count(*) AS n, sum(size)::BIGINT AS total FROM v WHERE size IS NOT NULL UNION ALL SELECT 'array', count(*), sum(size)::BIGINT FROM v WHERE size IS NOT NULL UNION ALL SELECT 'each', count(*), sum(size)::BIGINT FROM v WHERE size IS NOT NULL UNION ALL SELECT 'next', 1, min(size) FROM v")
def iterated_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = graph_of(spark, sf_dir).traversal().V().values("size")
    each: list[int] = []
    sizes.forEachRemaining(each.append)
    lists = {"list": sizes.toList(), "array": sizes.toArray().tolist(), "each": each, "next": [sizes.min().next()]}
    return spark.createDataFrame([(k, len(x), int(sum(x))) for k, x in lists.items()], "how string, n long, total long")


# Subgraphs
_SUB = f"+ g AS (SELECT e.id, src, dst FROM e JOIN v ON src = v.id WHERE {_EDGES}), p AS (SELECT vid, row_number() OVER (ORDER BY vid) - 1 AS place FROM (SELECT DISTINCT unnest([src, dst]) AS vid FROM g))\n"


@query("subgraph_step", _SUB + "SELECT row_number() OVER (ORDER BY g.id) - 1 AS id, a.place AS src, b.place AS dst, 'retrieved_edge' AS label, g.id AS original_id FROM g JOIN p a ON a.vid = g.src JOIN p b ON b.vid = g.dst")
def subgraph_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = graph_of(spark, sf_dir).traversal().V().hasLabel("customer").has("acctbal", P.gt(9900)).outE("placed").subgraph("rich").iterate()
    return t.getTraversalProperty("rich").edges.select("id", "src", "dst", "label", "original_id")


@query("subgraph_places", _SUB + "SELECT a.place AS src, b.place AS dst, g.src AS vid FROM g JOIN p a ON a.vid = g.src JOIN p b ON b.vid = g.dst")
def subgraph_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph's own method, from ids in a table."""
    graph, edges = _rich(spark, sf_dir)
    places, ends = graph.subgraph_coo(edges)
    return ends.join(places.withColumnRenamed("place", "src"), "src").select("src", "dst", "vid")


@query("model_inputs", _SUB + "SELECT b.place AS src, a.place AS dst, round(x.embedding[1]::DOUBLE, 6) AS first FROM g JOIN p a ON a.vid = g.src JOIN p b ON b.vid = g.dst LEFT JOIN embeddings x ON x.vec_id + " + str(V["customer"]) + " = g.src")
def model_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, edges = _rich(spark, sf_dir)
    features, ends = edge_index(graph, edges, "emb")
    own = features.select(F.col("place").alias("dst"), F.round(F.col("vec")[0].cast("double"), 6).alias("first"))
    return ends.join(own, "dst", "left").select("src", "dst", "first")


# Readers and writers
@query("edge_list_file", "SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation")
def edge_list_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = written_path(spark, "edge-list")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    nation.select(F.concat(F.lit("n"), "n_nationkey", F.lit("  r"), "n_regionkey")).write.text(path)
    graph = edge_list(spark, path)
    name = lambda c: graph.vertices.select(F.col("id").alias(c), F.col("name").alias(f"{c}_name"))
    return graph.edges.select("src", "dst").join(name("src"), "src").join(name("dst"), "dst").select(F.col("src_name").alias("src"), F.col("dst_name").alias("dst"))


@query("flight_files", "SELECT 'N' || c_nationkey AS src, 'S' || (o_orderkey % 25) AS dst, datediff('day', DATE '2019-01-01', o_orderdate::DATE)::INT AS time, 'F' || o_orderkey AS flight_number FROM orders JOIN customer ON c_custkey = o_custkey")
def flight_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as flights from the customer's nation."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    nodes, edges = written_path(spark, "airports"), written_path(spark, "flights")
    place = F.explode(F.array(F.concat(F.lit("N"), "n_nationkey"), F.concat(F.lit("S"), "n_nationkey"))).alias("name")
    write_csv(read("nation").select(place, F.lit("large").alias("type"), F.lit("EU").alias("continent"), F.lit("x").alias("region"), F.lit(1.5).alias("longitude"), F.lit(2.5).alias("latitude")), nodes)
    both = read("orders").join(read("customer"), F.col("c_custkey") == F.col("o_custkey"))
    write_csv(both.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.concat(F.lit("N"), "c_nationkey").alias("src"), F.concat(F.lit("S"), F.col("o_orderkey") % 25).alias("dst"), F.concat(F.lit("F"), "o_orderkey").alias("flight_number"), F.lit("jet").alias("plane")), edges)
    graph = flights(spark, nodes, edges)
    name = lambda c: graph.vertices.select(F.col("id").alias(c), F.col("name").alias(f"{c}_name"))
    own = graph.edges.select("src", "dst", "time", "flight_number").join(name("src"), "src").join(name("dst"), "dst")
    return own.select(F.col("src_name").alias("src"), F.col("dst_name").alias("dst"), "time", "flight_number")


@query("csv_property_tables", "SELECT l_partkey AS src, l_suppkey AS dst, p_size AS size, l_quantity AS quantity FROM lineitem JOIN part ON p_partkey = l_partkey")
def csv_property_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices, edges = written_path(spark, "parts"), written_path(spark, "lines")
    write_csv(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", "p_size"), vertices)
    write_csv(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_suppkey", "l_quantity"), edges)
    graph = csv_tables(spark, vertices, "id long, brand string, size int", "id", edges, "part long, supplier long, quantity double", "part", "supplier", "supplied", drop=["brand"])
    return graph.edges.join(graph.vertices.select(F.col("id").alias("src"), "size"), "src").select("src", "dst", "size", "quantity")


@query(
    "wiki_lines",
    """+ a AS (SELECT conv_id, count(*) AS n, row_number() OVER (ORDER BY conv_id) - 1 AS article FROM conversations GROUP BY conv_id),
o AS (SELECT *, sum(n) OVER (ORDER BY article) - n + (SELECT count(*) FROM a) AS first FROM a),
turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM conversations)
SELECT 'contains' AS label, article AS src, (first + place)::BIGINT AS dst FROM o JOIN turns USING (conv_id)
UNION ALL SELECT 'mention', o.first::BIGINT, t.article FROM o JOIN a t ON t.conv_id = o.conv_id + 1""",
)
def wiki_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as articles of sentences, each mentioning the next one in its first sentence."""
    path = written_path(spark, "articles")
    turns = joined_texts(spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("code", F.md5(F.coalesce("text", F.lit("")))), ["conv_id"], "code", ["turn"])
    mention = F.struct(F.lit(0).cast("long").alias("sent_idx"), F.array((F.col("conv_id") + 1).cast("string")).alias("ref_ids"), F.lit("").alias("ref_url"))
    json_lines(turns.select(F.col("conv_id").cast("string").alias("id"), F.concat(F.lit("t"), "conv_id").alias("title"), F.split("context", " ").alias("sentences"), F.array(mention).alias("mentions"))).write.text(path)
    return wiki(spark, path).edges.select("label", "src", "dst")


@query("arrays_in_memory", "SELECT n_nationkey::BIGINT AS src, n_regionkey::BIGINT AS dst, n_nationkey * 2.5::DOUBLE AS value FROM nation")
def arrays_in_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = np.array(spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_regionkey").collect(), np.int64)
    n = int(rows.max()) + 1
    graph = from_arrays(spark, n, rows[:, 0], rows[:, 1], "in", {"value": np.arange(n) * 2.5})
    return graph.edges.join(graph.view_vertex_property("value").withColumnRenamed("id", "src"), "src").select("src", "dst", "value")


@query("json_and_csv_lines", """SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' AS value FROM nation UNION ALL SELECT r_regionkey || ',' || r_name FROM region""")
def json_and_csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = written_path(spark, "csv")
    write_csv(spark.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey", "r_name"), path)
    back = spark.read.csv(path, header=True, schema="k int, name string").select(F.concat_ws(",", "k", "name").alias("value"))
    return json_lines(spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")).unionByName(back)


@query("text_vectors", "SELECT n_nationkey::BIGINT AS id, generate_subscripts(embedding, 1) - 1 AS place, round(unnest(embedding)::DOUBLE, 6) AS x FROM nation JOIN embeddings ON vec_id = n_nationkey")
def text_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of one known and one unknown word, encoded to part files and read again."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    vectors = nation.join(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") == F.col("n_nationkey")).select(F.col("n_name").alias("word"), F.col("embedding").alias("vec"))
    path = written_path(spark, "vectors")
    write_text_vectors(nation.select(F.col("n_nationkey").cast("long").alias("id"), F.concat("n_name", F.lit("  unknown")).alias("text")), "text", "id", vectors, path)
    return spark.read.parquet(path).select("id", F.posexplode("vec").alias("place", "x")).select("id", F.col("place").cast("long").alias("place"), F.round("x", 6).alias("x"))


@query("scalar_functions", """SELECT o_orderkey AS k, datediff('day', DATE '2019-01-01', o_orderdate::DATE)::INT AS day, 3::BIGINT AS rank, o_orderkey AS number, 2 AS n_words, 'a' || o_orderkey AS first, 'Question: Given the information below, q?' || chr(10) || chr(10) || 'Answer:' AS prompt FROM orders""")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), "o_orderdate")
    key = part_key(F.concat(F.lit("s3/x/part_3_"), "k", F.lit(".npy")))
    own = words(F.concat(F.lit("  a"), "k", F.lit(" \t b ")))
    return orders.select("k", day_number(F.col("o_orderdate")).alias("day"), key["rank"].alias("rank"), key["number"].alias("number"), F.size(own).alias("n_words"), first_item(own).alias("first"), prompt(F.lit("q?"), F.lit(None).cast("string")).alias("prompt"))


# Draws
@query("split_parts", "SELECT count(*) AS n, count(*) AS together, true AS near FROM orders")
def split_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three parts of the orders: together all of them, none twice, sizes near the shares asked for."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    parts = [p.withColumn("part", F.lit(k)) for k, p in enumerate(split(orders, [0.8, 0.1, 0.1], ["o_orderkey"], seed=5))]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return whole.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("together"), (F.abs(F.avg((F.col("part") == 0).cast("int")) - 0.8) < 0.05).alias("near"))


@query("drawn_settings", "SELECT 12::BIGINT AS n, 12::BIGINT AS different, true AS inside")
def settings_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = {"hops": [1, 2, 3], "k": [5, 10, 20, 40], "metric": ["cosine", "dot"]}
    own = drawn_settings(grid, 12, seed=3)
    inside = all(s[k] in grid[k] for s in own for k in grid)
    return spark.createDataFrame([(len(own), len({tuple(s.values()) for s in own}), inside)], "n long, different long, inside boolean")


# Vector search over many queries: every id that divides by 100, against all vectors
_EACH = f"""+ c AS (SELECT a.vec_id AS qid, b.vec_id AS id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rank FROM c)
SELECT {V['customer']} + qid AS query, {V['customer']} + id AS id, rank::INT AS rank, round(s, 6) AS score FROM r WHERE rank <= 10"""


def _queries(graph: PropertyGraph) -> DataFrame:
    return graph.embedding("emb").where((F.col("id") - V["customer"]) % 100 == 0)


@query("nearest_exact", _EACH)
def nearest_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = graph_of(spark, sf_dir)
    return nearest_each(graph.embedding("emb"), _queries(graph), 10).withColumn("score", F.round("score", 6))


@query("nearest_cells", None)
def nearest_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate, thus without SQL; the tests measure its recall."""
    graph = graph_of(spark, sf_dir)
    index = CellIndex.fit(graph.embedding("emb"))
    found = nearest_each(graph.embedding("emb"), _queries(graph), 10, index=index, probes=max(8, len(index.centres) // 2))
    return found.withColumn("score", F.round("score", 6))


@query("nearest_codes", None)
def nearest_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By product quantisation, approximate."""
    graph = graph_of(spark, sf_dir)
    index = CellIndex.fit(graph.embedding("emb"))
    return index.nearest_by_codes([vector_of(spark, sf_dir, 0), vector_of(spark, sf_dir, 7)], 20, probes=max(8, len(index.centres) // 2))
