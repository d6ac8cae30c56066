"""Readers, writers and streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.sources.readers import edge_list, embedding_parts, flights, interned, wiki, with_properties
from loomgraph.sources.star import VERTICES, conversations, line_id, star, turn_id
from loomgraph.sources.writers import csv_lines, json_lines, write_csv, write_json, write_parquet
from loomgraph.streaming.ingest import append_edges, running_degrees, windowed_edges


def test_short_lines(spark, tmp_path):
    (tmp_path / "g.txt").write_text("b a\n\nlonely\n a   c extra\n")
    graph = edge_list(spark, str(tmp_path / "g.txt"))
    assert {r.name: r.id for r in graph.vertices.collect()} == {"b": 0, "a": 1, "c": 2}
    assert [(r.src, r.dst) for r in graph.edges.orderBy("id").collect()] == [(0, 1), (1, 2)]


def test_interned_by_name(spark):
    pairs = spark.createDataFrame([("y", "x", 1.5), ("x", "z", None)], "src string, dst string, w double")
    graph = interned(pairs, "e")
    assert {r.name: r.id for r in graph.vertices.collect()} == {"x": 0, "y": 1, "z": 2} and graph.num_edges() == 2


def test_flights(spark, tmp_path):
    (tmp_path / "n.csv").write_text("name,type,continent,region,longitude,latitude\nA,big,EU,r,1.5,2.5\nB,small,EU,r,3,4\nshort,row\n")
    (tmp_path / "e.csv").write_text("date,src,dst,flight_number,plane\n2019-01-03,A,B,F1,P\n2019-02-01,B,A,,\n2019-01-01,A,X,F,P\n")
    graph = flights(spark, str(tmp_path / "n.csv"), str(tmp_path / "e.csv"))
    g = graph.traversal()
    assert sorted(g.V().has("longitude").values("name").toList()) == ["A", "B"]
    assert sorted(g.E().values("time").toList()) == [2, 31] and g.E().has("flight_number").count().next() == 1


def test_tables(spark):
    v = spark.createDataFrame([(1, 2000.0, None), (2, None, 5)], "PATENT long, year double, n int")
    e = spark.createDataFrame([(1, 2), (1, 1)], "citing long, cited long")
    graph = with_properties(spark, v, "PATENT", e, "citing", "cited", "citation")
    assert graph.vertex_property_names() == ["year", "n"] and graph.traversal().V(1).out("citation").count().next() == 2
    assert graph.vertex_property_entries("year") == 1


def test_wiki(spark, tmp_path):
    rows = [
        {"id": "20", "title": "B", "sentences": ["b0"], "mentions": [{"sent_idx": 0, "ref_ids": ["10"], "ref_url": "u"}, {"sent_idx": None, "ref_ids": ["10"]}, {"sent_idx": 0, "ref_ids": None}, {"sent_idx": 0, "ref_ids": ["99"]}]},
        {"id": "10", "title": "A", "sentences": [], "mentions": []},
        {"id": "30", "title": "C", "sentences": ["c0", "c1"], "mentions": [{"sent_idx": 1, "ref_ids": ["20", "10"]}]},
    ]
    (tmp_path / "w.json").write_text("\n".join(map(json.dumps, rows)))
    graph = wiki(spark, str(tmp_path / "w.json"))
    v = {r.id: (r.label, r.title or r.text) for r in graph.vertices.collect()}
    assert v == {0: ("article", "A"), 1: ("article", "B"), 2: ("article", "C"), 3: ("sentence", None), 4: ("sentence", "b0"), 5: ("sentence", "c0"), 6: ("sentence", "c1")}
    g = graph.traversal()
    assert sorted((r.src, r.dst) for r in graph.edges.where("label = 'mention'").collect()) == [(4, 0), (6, 1)]
    assert sorted(g.V(2).out("contains").toList()) == [5, 6]
    up = wiki(spark, str(tmp_path / "w.json"), contains_up=True)
    assert up.traversal().V(6).out("contains").toList() == [2]


def test_embedding_parts(spark, tmp_path):
    data = np.arange(10, dtype=np.float32).reshape(5, 2)
    for name, rows in (("part_1_0", data[4:]), ("part_0_10", data[3:4]), ("part_0_2", data[:3])):
        np.save(tmp_path / f"{name}.npy", rows)
    (tmp_path / "other.txt").write_text("x")
    got = {r.id: r.vec for r in embedding_parts(spark, str(tmp_path), first=7).collect()}
    assert got == {7 + k: row.tolist() for k, row in enumerate(data)}


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a,"b'), (2, None)], "k long, s string")
    assert sorted(r.value for r in json_lines(df).collect()) == ['{"k":1,"s":"a,\\"b"}', '{"k":2}']
    assert csv_lines(df).count() == 2
    write_csv(df, str(tmp_path / "c"))
    write_json(df, str(tmp_path / "j"))
    write_parquet(df, str(tmp_path / "p"), by="k")
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == spark.read.json(str(tmp_path / "j")).count() == spark.read.parquet(str(tmp_path / "p")).count() == 2


def test_star(spark):
    sf = "/root/testdata/sf0.001"
    graph = star(spark, sf)
    assert graph.dangling_edges().count() == 0
    assert graph.edges.count() == graph.edges.select("id").distinct().count()
    assert graph.vertices.select("id").distinct().count() == graph.num_vertices()
    assert graph.traversal().V().hasLabel("region").limit(1).next() == VERTICES["region"] << 40
    plan = graph.traversal().V().hasLabel("customer").out("placed").count().toDF()._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and "part.parquet" not in plan
    turns = conversations(spark, sf)
    assert turns.num_vertices() - turns.num_edges() == spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id").distinct().count()


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(0, 1, "e", "2020-01-01 00:00:01"), (0, 2, "e", "2020-01-01 00:00:02"), (1, 2, "f", "2020-01-01 00:01:30")], "src long, dst long, label string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    append_edges(read(), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    rows.write.mode("append").parquet(str(tmp_path / "in"))
    append_edges(read(), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 6 and got.select("id").distinct().count() == 6
    for name, frame, mode in (("degrees", running_degrees(read()), "complete"), ("windows", windowed_edges(read(), "ts", "1 minute", "10 minutes"), "complete")):
        q = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
    assert {r.id: r.degree for r in spark.table("degrees").collect()} == {0: 4, 1: 2}
    assert sorted((r.label, r.n) for r in spark.table("windows").collect()) == [("e", 4), ("f", 2)]


def test_large_groups(spark, tmp_path):
    """Conversations of 1024 turns and more, and orders of as many lines, share no ids with the next ones; what fits no id fails."""
    spark.range(1500).selectExpr("IF(id < 1300, 1, 2) AS conv_id", "IF(id < 1300, id, id - 1300) AS turn", "'user' AS role", "'t' AS text").write.parquet(f"{tmp_path}/conversations.parquet")
    turns = conversations(spark, str(tmp_path))
    assert turns.vertices.select("id").distinct().count() == 1500 and turns.num_edges() == 1498
    assert turns.edges.select("id").distinct().count() == 1498 and turns.dangling_edges().count() == 0
    assert turns.vertices.join(turns.edges, turns.vertices["id"] == turns.edges["dst"], "left_anti").count() == 2
    small = spark.range(1300).selectExpr("IF(id < 1200, 1, 2) AS o", "IF(id < 1200, id, id - 1200) AS n")
    for name in ("contains", "filled_by"):
        assert small.select(line_id(name, F.col("o"), F.col("n")).alias("id")).distinct().count() == 1300
    with pytest.raises(Exception, match="no id of turn"):
        spark.range(1).select(turn_id(F.lit(1), F.lit(-1))).collect()
