import zlib

import numpy as np
import pyarrow as pa

from loomgraph.llm.quality import BUCKETS, RANK, STATS, Machine, features, held_out, kept, scored, train


def test_sum_of_squares_identity():
    r = np.random.default_rng(0)
    m = Machine()
    m.v = r.normal(size=(BUCKETS + len(STATS), RANK)).astype(np.float32)
    m.w = r.normal(size=BUCKETS + len(STATS)).astype(np.float32)
    at, index, value, stats = features(pa.array(["some words and some more", "", "x"]), np.array([24.0, 0, np.nan]))
    starts, i, x = m._rows(at, index, value, stats)
    raw = m._raw(starts, i, x)[0]
    for d in range(3):
        ids, xs = i[starts[d] : starts[d + 1]], x[starts[d] : starts[d + 1]]
        pairs = sum(float(m.v[ids[a]] @ m.v[ids[b]]) * xs[a] * xs[b] for a in range(len(ids)) for b in range(a))
        assert abs(m.w0 + (m.w[ids] * xs).sum() + pairs - raw[d]) < 1e-2


def test_features():
    at, index, value, stats = features(pa.array(["Ab ab ab|", ""]), np.array([9.0, np.nan]))
    assert at.tolist() == [0, 2, 2] and abs((value**2).sum() - 1) < 1e-6 and np.isfinite(stats).all()
    # Slices of a column give the same.
    a = features(pa.array(["zzz", "Ab ab ab|", "q"]).slice(1, 1), np.array([9.0]))
    assert a[1].tolist() == index.tolist() and (a[3] == stats[:1]).all()


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = scored(docs.select("doc_id", "text", "n_chars"), train(docs, labels)).join(labels, "doc_id").select("doc_id", held_out(labels["doc_id"]).alias("h"), "score", "quality").collect()
    for r in got:
        assert r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    own = [(r.score, r.quality) for r in got if r.h]
    bad, good = [s for s, q in own if q == 0], [s for s, q in own if q == 1]
    assert np.mean([(b < g) + (b == g) / 2 for b in bad for g in good]) > 0.97
    assert np.mean([s >= 0.3 for s in good]) > 0.97 and np.mean([s < 0.3 for s in bad]) > 0.6


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "some text", "c"), (2, "", "d"), (3, "word " * 30000, None)], "doc_id long, text string, score string")
    none = spark.createDataFrame([(1, None, 0), (None, 1, 0)], "doc_id long, quality int, text int")
    rows = scored(docs, train(docs, none)).collect()
    assert [r.score_1 for r in rows] == [0.5] * 5 and [r.score for r in rows] == ["a", "b", "c", "d", None]
    one = spark.createDataFrame([(2, 1), (3, 1), (3, 0)], "doc_id long, quality int")
    assert all(0.5 < r.score_1 < 1 for r in scored(docs, train(docs, one)).collect())
    assert kept(docs, train(docs, one)).columns == docs.columns and kept(docs, train(docs, one)).count() == 5
    assert scored(docs.where("false"), train(docs, one)).collect() == []
