"""Readers of the formats that graphs come in.  Schemas are given, not inferred, so nothing is read twice."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import day_number, first_item, part_key
from ..graph import PropertyGraph, numbered
from ..storage import written


def interned(pairs: DataFrame, label: str, vertex_label: str = "", order: str | None = None) -> PropertyGraph:
    """A graph of named ends (columns ``src``, ``dst``): ids 0, 1, ... in the order in which names are first seen, sources before destinations of a row.

    ``order`` names a column with the rows' order (and it goes); without it names are numbered in their own order.
    """
    spark = pairs.sparkSession
    if order is None:
        names = pairs.select(F.explode(F.array("src", "dst")).alias("name")).distinct()
        ids = numbered(names, "id", F.col("name"))
        edges = numbered(pairs.select("src", "dst"), "id", F.col("src"), F.col("dst"))
    else:
        seen = pairs.select(order, F.posexplode(F.array("src", "dst")).alias("end", "name")).groupBy("name").agg(F.min(F.struct(order, "end")).alias("first"))
        ids = numbered(seen, "id", F.col("first"))
        edges = numbered(pairs, "id", F.col(order))
    ids = written(ids.select("id", "name"), "names")
    a, b = (ids.select(F.col("id").alias(f"i_{c}"), F.col("name").alias(f"n_{c}")) for c in "ab")
    ends = edges.join(a, F.col("src") == F.col("n_a")).join(b, F.col("dst") == F.col("n_b"))
    rest = [c for c in edges.columns if c not in ("id", "src", "dst", order)]
    return PropertyGraph(spark, ids.select("id", F.lit(vertex_label).alias("label"), "name"), ends.select("id", F.col("i_a").alias("src"), F.col("i_b").alias("dst"), F.lit(label).alias("label"), *rest))


def edge_list(spark: SparkSession, path: str, label: str = "basic_edge", vertex_label: str = "basic_vertex") -> PropertyGraph:
    """Lines of two names with white space between; lines with fewer are left out.

    The lines' order is that of files and of places within them, so a file of any number of splits is numbered the same.
    """
    text = spark.read.text(path).select(F.col("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    words = F.split(F.trim("value"), "\\s+")
    rows = text.where(F.size(words) >= 2).select(words[0].alias("src"), words[1].alias("dst"), F.struct("file", "block", "row").alias("line"))
    return interned(written(rows, "lines"), label, vertex_label, "line")


def flights(spark: SparkSession, nodes: str, edges: str) -> PropertyGraph:
    """Airports (name, type, continent, region, longitude, latitude) and dated flights between them; rows that are too short are left out.

    A flight's ``time`` is its day number.
    """
    n = spark.read.csv(nodes, header=True, mode="DROPMALFORMED", schema="name string, type string, continent string, region string, longitude double, latitude double")
    e = spark.read.csv(edges, header=True, schema="date string, src string, dst string, flight_number string, plane string").where("date IS NOT NULL AND src IS NOT NULL AND dst IS NOT NULL")
    ids = written(numbered(n.where("name IS NOT NULL").dropDuplicates(["name"]), "id", F.col("name")), "names")
    a, b = (ids.select(F.col("id").alias(f"i_{c}"), F.col("name").alias(f"n_{c}")) for c in "ab")
    ends = e.join(a, F.col("src") == F.col("n_a")).join(b, F.col("dst") == F.col("n_b"))
    rows = ends.select(F.col("i_a").alias("from"), F.col("i_b").alias("to"), day_number(F.col("date")).alias("time"), "flight_number", "plane")
    own = numbered(rows, "id", F.col("time"), F.col("from"), F.col("to"), F.col("flight_number"), F.col("plane"))
    return PropertyGraph(spark, ids.select("id", F.lit("airport").alias("label"), "name", "type", "continent", "region", "longitude", "latitude"), own.select("id", F.col("from").alias("src"), F.col("to").alias("dst"), F.lit("flight").alias("label"), "time", "flight_number", "plane"))


def with_properties(spark: SparkSession, vertices: DataFrame, id_col: str, edges: DataFrame, src: str, dst: str, label: str, vertex_label: str = "") -> PropertyGraph:
    """Tables whose ids are whole numbers: other columns become properties, nulls are missing ones."""
    v = vertices.select(F.col(id_col).cast("long").alias("id"), F.lit(vertex_label).alias("label"), *[c for c in vertices.columns if c != id_col])
    e = numbered(edges, "id", F.col(src), F.col(dst))
    return PropertyGraph(spark, v, e.select("id", F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"), F.lit(label).alias("label"), *[c for c in edges.columns if c not in (src, dst)]))


def csv_tables(spark: SparkSession, vertices: str, vertex_schema: str, id_col: str, edges: str, edge_schema: str, src: str, dst: str, label: str, vertex_label: str = "", drop: Sequence[str] = ()) -> PropertyGraph:
    """CSV files with a header whose ids are whole numbers, such as tables of patents and their citations.

    Schemas name the files' columns in their order.  Columns ``drop`` are not read on; a row without an id or an end is left out, an empty field is a
    missing property.
    """
    v = spark.read.csv(vertices, header=True, schema=vertex_schema).where(F.col(id_col).isNotNull()).drop(*drop)
    e = spark.read.csv(edges, header=True, schema=edge_schema).where(F.col(src).isNotNull() & F.col(dst).isNotNull()).drop(*drop)
    return with_properties(spark, v, id_col, e, src, dst, label, vertex_label)


WIKI = "id string, title string, sentences array<string>, mentions array<struct<sent_idx:bigint, ref_ids:array<string>, ref_url:string>>"


def exploded_sentences(articles: DataFrame) -> DataFrame:
    """``article, place, sentence``; an article without sentences keeps one row with a null."""
    return articles.select("article", F.posexplode_outer("sentences").alias("place", "sentence")).withColumn("place", F.coalesce("place", F.lit(0)))


def sentence_offsets(articles: DataFrame) -> DataFrame:
    """``article, offset``: sentences of all articles before; none counts as one.

    Sizes are summed over ranges of articles first, thus no task sees all articles.
    """
    sized = written(articles.select("article", F.greatest(F.coalesce(F.size("sentences"), F.lit(1)), F.lit(1)).cast("long").alias("n")).withColumn("range", F.floor(F.col("article") / 100_000)), "sizes")
    totals = sized.groupBy("range").agg(F.sum("n").alias("total"))
    before = totals.select("range", F.coalesce(F.sum("total").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.coalesce(F.sum("n").over(Window.partitionBy("range").orderBy("article").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sized.withColumn("within", within).join(before, "range").select("article", (F.col("before") + F.col("within")).alias("offset"))


def wiki(spark: SparkSession, path: str | DataFrame, contains_up: bool = False) -> PropertyGraph:
    """Articles and their sentences: vertices 0 to A-1 are articles in order of their ids, A and on sentences.

    Edges ``mention`` from a sentence to the article that it refers to first, ``contains`` from an article to its sentences, or with
    ``contains_up`` from sentences to their article.  Mentions without sentence or of unknown articles are left out.
    """
    raw = spark.read.schema(WIKI).json(path) if isinstance(path, str) else path
    articles = written(numbered(raw.withColumn("number", F.col("id").cast("long")), "article", F.col("number"), F.col("title")), "articles")
    n = articles.count()
    offsets = written(sentence_offsets(articles), "offsets")
    own = exploded_sentences(articles).join(offsets, "article").withColumn("vertex", F.col("offset") + F.col("place") + n)
    vertices = articles.select(F.col("article").alias("id"), F.lit("article").alias("label"), "title", F.lit(None).cast("string").alias("text")).unionByName(own.select(F.col("vertex").alias("id"), F.lit("sentence").alias("label"), F.lit(None).cast("string").alias("title"), F.col("sentence").alias("text")))
    m = articles.select("article", F.explode("mentions").alias("m")).select("article", F.col("m.sent_idx").alias("place"), first_item(F.col("m.ref_ids")).cast("long").alias("ref")).where("place IS NOT NULL AND ref IS NOT NULL")
    targets = articles.select(F.col("number").alias("ref"), F.col("article").alias("target"))
    mentions = m.join(targets, "ref").join(offsets, "article").select((F.col("offset") + F.col("place") + n).alias("src"), F.col("target").alias("dst"), F.lit("mention").alias("label"))
    down, up = F.col("article"), F.col("vertex")
    contains = own.select((up if contains_up else down).alias("src"), (down if contains_up else up).alias("dst"), F.lit("contains").alias("label"))
    edges = numbered(mentions.unionByName(contains), "id", (F.col("label") != "mention").cast("int"), F.col("src"), F.col("dst"))
    return PropertyGraph(spark, vertices, edges.select("id", "src", "dst", "label"))


def embedding_parts(spark: SparkSession, path: str, first: int = 0) -> DataFrame:
    """``id, vec`` of arrays in files ``part_<rank>_<number>.npy``, rows numbered from ``first`` in order of rank, number and row."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for rank, number, content in zip(frame["rank"], frame["number"], frame["content"], strict=True):
                x = np.load(io.BytesIO(content), allow_pickle=False).astype(np.float32)
                yield pd.DataFrame({"rank": rank, "number": number, "row": np.arange(len(x)), "vec": list(x)})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part_*.npy").load(path)
    own = files.select(part_key(F.col("path")).alias("k"), "content").select("k.rank", "k.number", "content")
    rows = own.mapInPandas(read, "rank long, number long, row long, vec array<float>")
    return numbered(rows, "id", F.col("rank"), F.col("number"), F.col("row")).select((F.col("id") + first).alias("id"), "vec")


def from_arrays(spark: SparkSession, n: int, src: Sequence[int], dst: Sequence[int], label: str, properties: dict[str, Sequence] | None = None) -> PropertyGraph:
    """``n`` vertices and edges from arrays in memory; properties are as long as there are vertices."""
    graph = PropertyGraph(spark)
    graph.add_vertices(n)
    graph.add_edges(src, dst, label)
    for name, values in (properties or {}).items():
        graph.set_vertex_properties(name, spark.createDataFrame(pa.table({"id": np.arange(n), "value": np.asarray(values)})))
    return graph
