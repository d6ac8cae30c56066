import random
import re

import xxhash
from pyspark.sql import functions as F

from loomgraph.llm.components import connected_components
from loomgraph.llm.simhash import fingerprint, links, near_duplicates


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """fps: {id: fingerprint}."""
    label = {i: i for i in fps}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(fps)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_fingerprint():
    for text in ["", " \n", "a", "A b", "One two  three", "É x y z É x y z", "w " * 9000, "ſ K b c d e"]:
        assert fingerprint(text.encode()) == brute_fingerprint(text)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "same words in this text here"), (4, "SAME words in\tthis text here"), (5, "same words in this text here"), (None, "same words in this text here"), (6, "x " * 30000), (7, "other")]
    docs = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "doc_id long, text string, fp int, component_id int")
    got = {(r.doc_id, r.component_id) for r in near_duplicates(docs).collect()}
    assert got == {(1, 1), (2, 1), (3, 3), (4, 3), (5, 3), (None, None), (6, 6), (7, 7)}
    assert near_duplicates(docs.where("false")).collect() == []


def test_links_in_dense_groups(spark):
    """A group whose members share most blocks; the bound that divides a bucket is small, so that all divisions run."""
    r = random.Random(1)
    base = r.getrandbits(64)
    fps = {base}
    while len(fps) < 250:
        fps.add(base ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))))
    fps |= {r.getrandbits(64) for _ in range(100)}
    fps = dict(enumerate(sorted(fps)))
    nodes = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in fps.items()], "node long, fp long")
    want = brute_components(fps)
    for most in (5, 40, 2000):
        got = {i: i for i in fps} | {x.node: x.root for x in connected_components(links(nodes, most)).collect()}
        assert got == want


def test_components_of_a_path(spark):
    n = 300
    links_ = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).orderBy(F.rand(3))
    got = {r.node: r.root for r in connected_components(links_).collect()}
    assert got == {i: 0 for i in range(n + 1)}


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in near_duplicates(docs).collect()}
    fps = {r.doc_id: brute_fingerprint(r.text) for r in docs.collect()}
    assert {i: x for i, (x, _) in got.items()} == fps
    assert {i: x for i, (_, x) in got.items()} == brute_components(fps)
