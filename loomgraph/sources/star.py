"""The star schema of customers, orders and parts as a property graph.

A vertex id is its label's number times 2**40 plus the table's key, so ids need no numbering.  Edges of tables with a key take it likewise, times
2**58; the lines of an order, which have no key, are numbered within their order, by all their columns, and groups of any size keep ids apart.  As every label is a literal, a
filter by label leaves just the tables that have it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..graph import PropertyGraph
from ..storage import written

VERTICES = {"region": 1, "nation": 2, "customer": 3, "supplier": 4, "part": 5, "order": 6, "turn": 7}
EDGES = {"in_region": 1, "customer_in": 2, "supplier_in": 3, "placed": 4, "contains": 5, "filled_by": 6, "next": 7}
#: Places of a group, a turn's of a conversation or a line's of an order, whose ids lie side by side; those of later places lie apart (``placed_id``).
TURNS = LINES = 1024
#: Above all other ids, 2**61 for each kind of later place: so many bits for the place, the rest for its group.
APART = {"contains": 8 << 58, "filled_by": 16 << 58, "next": 24 << 58, "turn": 8 << 58}
PLACE_BITS, GROUP_BITS = 30, 31


def vertex(label: str, key: Column) -> Column:
    return (F.lit(VERTICES[label] << 40) + key.cast("long")).cast("long")


def edge(name: str, key: Column) -> Column:
    return (F.lit(EDGES[name] << 58) + key.cast("long")).cast("long")


def placed_id(name: str, base: int, room: int, many: int, group: Column, place: Column) -> Column:
    """The id of a place (0, 1, ...) in its group: group * many + place above ``base`` for the first ``many``, else apart.

    No two ids are equal; a group or place that doesn't fit its bits fails.
    """
    group, place = group.cast("long"), place.cast("long")
    fail = F.raise_error(F.concat(F.lit(f"no id of {name} for group and place "), group.cast("string"), F.lit(", "), place.cast("string"))).cast("long")
    near = (group >= 0) & (group < room // many) & (place >= 0) & (place < many)
    far = (group >= 0) & (group < 1 << GROUP_BITS) & (place >= many) & (place < 1 << PLACE_BITS)
    apart = F.lit(APART[name]) + group * F.lit(1 << PLACE_BITS) + place
    return F.when(group.isNull() | place.isNull(), F.lit(None).cast("long")).when(near, F.lit(base) + group * many + place).when(far, apart).otherwise(fail)


def turn_id(conversation: Column, turn: Column) -> Column:
    return placed_id("turn", VERTICES["turn"] << 40, 1 << 40, TURNS, conversation, turn)


def line_id(name: str, order: Column, number: Column) -> Column:
    return placed_id(name, EDGES[name] << 58, 1 << 58, LINES, order, number)


#: Properties of each vertex label (fixed values).
PROPERTIES = {
    "region": {"name": "r_name"},
    "nation": {"name": "n_name"},
    "customer": {"name": "c_name", "acctbal": "c_acctbal", "segment": "c_mktsegment"},
    "supplier": {"name": "s_name", "acctbal": "s_acctbal"},
    "part": {"name": "p_name", "brand": "p_brand", "size": "p_size", "price": "p_retailprice"},
    "order": {"status": "o_orderstatus", "price": "o_totalprice", "priority": "o_orderpriority", "date": "o_orderdate"},
}
TYPES = {"name": "string", "acctbal": "double", "segment": "string", "brand": "string", "size": "int", "price": "double", "status": "string", "priority": "string", "date": "timestamp_ntz"}
TABLES = {"region": ("region", "r_regionkey"), "nation": ("nation", "n_nationkey"), "customer": ("customer", "c_custkey"), "supplier": ("supplier", "s_suppkey"), "part": ("part", "p_partkey"), "order": ("orders", "o_orderkey")}


def _all(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionAll(p)
    return whole


_numbered: dict[tuple[str, str], DataFrame] = {}


def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their place in the order, numbered once in a session and written in order of orders, so that an order's lines are found by it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _numbered:
        _numbered.clear()
        lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
        number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*lines.columns)) - 1
        _numbered[key] = written(lines.withColumn("line", number).select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "line"), "lines")
    return _numbered[key]


def star(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    own = []
    for label, (name, key) in TABLES.items():
        columns = [F.col(PROPERTIES[label][p]).cast(t).alias(p) if p in PROPERTIES[label] else F.lit(None).cast(t).alias(p) for p, t in TYPES.items()]
        own.append(read(name).select(vertex(label, F.col(key)).alias("id"), F.lit(label).alias("label"), *columns))

    c = F.col

    def edges(df: DataFrame, id_: Column, src: Column, dst: Column, label: str, quantity: Column | None = None, price: Column | None = None, time: Column | None = None) -> DataFrame:
        null = F.lit(None)
        return df.select(id_.alias("id"), src.alias("src"), dst.alias("dst"), F.lit(label).alias("label"), (quantity if quantity is not None else null.cast("double")).alias("quantity"), (price if price is not None else null.cast("double")).alias("price"), (time if time is not None else null.cast("timestamp_ntz")).alias("time"))

    def all_edges(lines: DataFrame) -> DataFrame:
        return _all(
            [
                edges(read("nation"), edge("in_region", c("n_nationkey")), vertex("nation", c("n_nationkey")), vertex("region", c("n_regionkey")), "in_region"),
                edges(read("customer"), edge("customer_in", c("c_custkey")), vertex("customer", c("c_custkey")), vertex("nation", c("c_nationkey")), "in_nation"),
                edges(read("supplier"), edge("supplier_in", c("s_suppkey")), vertex("supplier", c("s_suppkey")), vertex("nation", c("s_nationkey")), "in_nation"),
                edges(read("orders"), edge("placed", c("o_orderkey")), vertex("customer", c("o_custkey")), vertex("order", c("o_orderkey")), "placed", time=c("o_orderdate")),
                edges(lines, line_id("contains", c("l_orderkey"), c("line")), vertex("order", c("l_orderkey")), vertex("part", c("l_partkey")), "contains", c("l_quantity"), c("l_extendedprice"), c("l_shipdate")),
                edges(lines, line_id("filled_by", c("l_orderkey"), c("line")), vertex("order", c("l_orderkey")), vertex("supplier", c("l_suppkey")), "filled_by", c("l_quantity"), c("l_extendedprice"), c("l_shipdate")),
            ]
        )

    # Lines are numbered, which deals and sorts them all, when an edge's id or property is first asked for; hops need neither.
    plain = read("lineitem").withColumn("line", F.lit(None).cast("int"))
    return PropertyGraph(
        spark,
        _all(own),
        lambda: all_edges(numbered_lines(spark, sf_dir)),
        {"emb": read("embeddings").select(vertex("customer", c("vec_id")).alias("id"), c("embedding").alias("vec"))},
        all_edges(plain).select("src", "dst", "label"),
    )


def conversations(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Turns, each with an edge to the one that follows."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turn, conversation = F.col("turn"), F.col("conv_id")
    follow = F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = rows.withColumn("follow", follow)
    edge_id = placed_id("next", EDGES["next"] << 58, 1 << 40, TURNS, conversation, turn)
    own = rows.select(turn_id(conversation, turn).alias("id"), F.lit("turn").alias("label"), "role", turn.cast("long").alias("turn"), "conv_id", turn_id(conversation, F.col("follow")).alias("next"), edge_id.alias("edge"))
    edges = own.where("next IS NOT NULL").select(F.col("edge").alias("id"), F.col("id").alias("src"), F.col("next").alias("dst"), F.lit("next").alias("label"))
    return PropertyGraph(spark, own.drop("next", "edge"), edges)
