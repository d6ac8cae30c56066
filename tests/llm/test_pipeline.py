import corpus_pipeline
from loomgraph.llm.decontaminate import contamination
from loomgraph.llm.quality import scored, train
from loomgraph.llm.simhash import near_duplicates


def test_stages(spark):
    """Each stage against its operator on what the stage before has kept."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kinds = docs.dtypes
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, sf).cache()
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "tokens":
            assert docs.dtypes == kinds
        else:
            assert docs.columns == [c for c, _ in kinds if c != "text"] + ["ids", "n_tokens", "ids_crc32", "round_trip"]
        if name == "quality":
            scores = scored(before, train(before, spark.read.parquet(f"{sf}/labels.parquet"))).collect()
            assert kept[name] == {r.doc_id for r in scores if r.score >= 0.3}
        if name == "near_dedup":
            rows = near_duplicates(before).collect()
            assert kept[name] == {r.component_id for r in rows}
        if name == "decontamination":
            assert kept[name] == {r.doc_id for r in contamination(before, spark.read.parquet(f"{sf}/benchmark.parquet")).collect() if not r.contaminated}
    assert kept["line_dedup"] == kept["quality"] and kept["tokens"] == kept["decontamination"]
    assert all(r.round_trip for r in docs.collect())
    assert {r.doc_id: r.ids_crc32 for r in corpus_pipeline.run(spark, sf).collect()} == {r.doc_id: r.ids_crc32 for r in docs.collect()}


def test_nulls_and_repeats(spark, tmp_path):
    docs = spark.createDataFrame([(1, "same text of several words here", "en", "s", 31), (1, "same text of several words here", "en", "s", 31), (2, None, None, None, None), (3, "", "en", "s", 0), (None, "a text without an id", "en", "s", 20)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.n_tokens > 0) for r in rows) == [("1", True), ("2", False), ("None", True)]


def test_odd_rows_and_names(spark, tmp_path):
    """Columns of any name go through all stages; long texts are whole, ties and repeats have their row."""
    names = ["row", "score", "drops", "kept", "batch", "component_id", "fp", "ids", "n_tokens", "decoded", "own text", "class", "dropped_id", "of"]
    line = "a line of more than twenty characters that all have"
    word = lambda k: "".join(chr(97 + k // 26**j % 26) for j in range(4))
    long = " ".join(word(k) for k in range(120_000))
    item = " ".join(word(k) for k in range(200_000, 200_020))
    texts = [(1, f"{line}\nfirst of its own kind of text here"), (2, f"{line}\nsecond text about another matter entirely"), (3, f"{line}\nthird one, unlike those before it"), (4, long), (5, long), (6, item), (7, ""), (8, None), (9, "x" * 300_000), (None, "no id here at all"), (None, "no id here at all")]
    docs = spark.createDataFrame([(i, t, *["c"] * len(names)) for i, t in texts], f"doc_id long, text string, {', '.join(f'`{n}` string' for n in names)}")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("item/1", item)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    done = corpus_pipeline.run(spark, str(tmp_path))
    assert done.columns == ["doc_id", *names, "ids_1", "n_tokens_1", "ids_crc32", "round_trip"]
    rows = done.collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(["1", "2", "3", "4", "7", "9", "None", "None"])
    assert all(r.round_trip and all(r[n] == "c" for n in names) for r in rows)
    assert {r.doc_id: r.n_tokens_1 for r in rows if r.doc_id}[4] > 120_000
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).collect() == []
