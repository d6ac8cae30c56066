import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.llm import decontaminate
from loomgraph.llm.decontaminate import Segment, build_index, contamination, decontaminated, search, windows_of, words_of


def brute_words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aB1 -_.éſ\x80日\n\x7f`{") | st.characters(exclude_categories=["Cs"]), max_size=60))
def test_words(text):
    assert words_of(text) == brute_words(text)


def brute(docs, items):
    out = []
    for i, text in docs:
        words, hit, found = brute_words(text), set(), set()
        for item, t in items:
            for w in windows_of(brute_words(t)):
                for k in range(len(words) - len(w) + 1):
                    if words[k : k + len(w)] == w:
                        hit |= set(range(k, k + len(w)))
                        found.add(item)
        out.append((i, len(words), len(hit), sorted(str(f) for f in found if f is not None), bool(hit) and 20 * len(hit) >= len(words)))
    return out


def frames(spark, docs, items):
    return spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n_words int"), spark.createDataFrame([(i, t, "c") for i, t in items], "item_id long, text string, doc_id string")


def test_edges(spark):
    long = " ".join(f"w{k}" for k in range(30))
    items = [(1, long), (2, "Three short WORDS"), (3, None), (4, "..."), (10, "é"), (None, "null item text"), (5, "a a a a a a a a a a a a a a")]
    docs = [(1, long), (2, "x " * 400 + " ".join(f"W{k}" for k in range(5, 18))), (3, None), (4, ""), (5, "three-short words, é and more"), (6, "three words short"), (7, "a " * 40), (None, "three short words"), (8, "null item text"), (9, "three short words"), (9, "three short words"), (11, "pad " * 50000 + "three short words")]
    d, b = frames(spark, docs, items)
    order = lambda r: (str(r[0]), r[1:])
    want = sorted(brute(docs, items), key=order)
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in contamination(d, b).collect()), key=order)
    assert got == want
    assert sorted(str(r.doc_id) for r in decontaminated(d, b).collect()) == sorted(str(r[0]) for r in want if not r[4])
    # Several blocks of items give the same rows, and so does an index of all terms.
    bag = lambda found: sorted(str(r) for r in found.select("doc_id", "n_words", F.array_sort("matches").alias("m")).collect())
    assert bag(search(d, b, block=20)) == bag(search(d, b))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(decontaminate, "VOCABULARY", 5)
        assert bag(search(d, b, block=20)) == bag(search(d, b))
    assert contamination(d.where("false"), b).collect() == []
    assert all(not r.contaminated for r in contamination(d, b.where("false")).collect())


def test_random(spark):
    r = random.Random(1)
    text = lambda n: " ".join(r.choice("abcd") for _ in range(n))
    items = [(k, text(r.choice([3, 13, 14, 20]))) for k in range(12)]
    docs = [(k, text(r.randint(0, 80)) + " " + (r.choice(items)[1] if k % 3 == 0 else "")) for k in range(60)]
    d, b = frames(spark, docs, items)
    got = sorted((x.doc_id, x.n_words, x.n_hit, x["items"], x.contaminated) for x in contamination(d, b).collect())
    assert got == sorted(brute(docs, items))


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "the quick brown fox and the lazy dog"), (2, "dog " + "x " * 40 + "fox"), (3, "nothing")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "dog fox")], "item_id long, text string")
    near = {r.doc_id: [m.item_id for m in r.matches] for r in search(docs, items, slop=5).collect()}
    assert near == {1: ["7"], 2: [], 3: []}
    assert [r.doc_id for r in search(docs, items, slop=50).where(F.size("matches") > 0).orderBy("doc_id").collect()] == [1, 2]


def test_index_of_all_terms(spark):
    docs = spark.createDataFrame([(1, "to be or not to be"), (2, "be")], "doc_id long, text string").coalesce(1)
    row = build_index(docs).collect()[0]
    seg = Segment(row.doc_ids, row.n_words, row.terms, row.sizes, row.postings)
    doc, place = seg.where(seg.phrase(["to", "be"]))
    assert doc.tolist() == [0, 0] and place.tolist() == [0, 4] and seg.phrase(["be", "be"]).tolist() == []


def test_blocks_by_row(spark):
    """Repeated and null ids: each row has its own hits and stays or goes by them, in one block of items and in several."""
    pad = " ".join(f"p{k}" for k in range(28))
    items = [(1, "alpha beta"), (2, "gamma delta"), (3, "epsilon zeta"), (4, "one two three")]
    docs = [(None, "alpha beta " + pad), (None, "nothing here " + pad), (7, "gamma delta " + pad), (7, "all is clean " + pad[3:]), (8, "epsilon zeta"), (8, "epsilon zeta"), (9, None), (9, None), (5, "alpha " + pad * 3), (5, "beta " + pad * 3)]
    d, b = frames(spark, docs, items)
    order = lambda r: (str(r[0]), r[1:])
    want = sorted(brute(docs, items), key=order)
    for block in (2, 4, 1000):
        got = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in contamination(d, b, block=block).collect()), key=order)
        assert got == want
        kept = decontaminated(d, b, block=block)
        assert kept.columns == d.columns
        bad = {t for (_, t), r in zip(docs, brute(docs, items), strict=True) if r[4]}
        assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == sorted((str(i), str(t)) for i, t in docs if t not in bad)


def test_named_items(spark):
    """Ids that are no numbers, sorted as strings."""
    docs = spark.createDataFrame([(1, "alpha beta gamma delta")], "doc_id long, text string")
    items = spark.createDataFrame([("mmlu/10", "alpha beta"), ("mmlu/9", "gamma delta")], "item_id string, text string")
    assert [r["items"] for r in contamination(docs, items).collect()] == [["mmlu/10", "mmlu/9"]]
