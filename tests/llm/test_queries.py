"""The registered queries as they are, last projections included, over the smallest tables against plain Python."""

import hashlib
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from loomgraph.llm.image_copies import keypoints, rasters
from loomgraph.llm.queries import QUERIES, SQL
from loomgraph.llm.simhash import fingerprint

from .test_image_copies import brute_links, classes
from .test_secrets import brute_base
from .test_token_counts import LONGEST, PIECES, brute_count, brute_words

SF = "/root/testdata/sf0.001"
KINDS = ("assign", "access", "hex")
sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def rows(spark, name):
    return QUERIES[name](spark, SF).collect()


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(SQL) <= set(QUERIES)


def test_op1(spark, texts):
    fps = {i: fingerprint(t.encode()) for i, t in texts.items()}
    links = [(a, b) for a, b in combinations(sorted(fps), 2) if (fps[a] ^ fps[b]).bit_count() <= 3]
    want = classes(links, fps)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows(spark, "op1_simhash")} == {i: (f"{f:016x}", want[i]) for i, f in fps.items()}


def test_op2(spark, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {i: (len(ids := library.encode(t)), crc(ids), sha(t.replace("▁", " "))) for i, t in texts.items()}
    assert {r.doc_id: (r.n_tokens, r.ids_crc32, r.decoded_sha256) for r in rows(spark, "op2_sentencepiece")} == want


def test_op3(spark, texts):
    got = rows(spark, "op3_quality")
    assert {r.doc_id for r in got} == set(texts)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_op4(spark, texts):
    for r in rows(spark, "op4_secrets"):
        base = brute_base(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == n for _, k, _ in base) for n in range(3))
        spans = [f"{KINDS[k]}:{a}:{b}" for a, k, b in base]
        assert r.base_sha256 == sha(",".join(spans))
        own = r.spans.split(",") if r.spans else []
        assert [s for s in own if not s.startswith("model:")] == spans and len(own) - len(spans) == r.n_model
        assert [int(s.split(":")[1]) for s in own] == sorted(int(s.split(":")[1]) for s in own)


def test_op6(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, start = {}, 0
    for i in sorted(texts):
        ids = [*library.encode(texts[i], add_special_tokens=False).ids, 1]
        want[i] = (start, len(ids), crc(ids))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in rows(spark, "op6_token_files")} == want


def test_op7(spark, texts):
    want = {i: (len(w := brute_words(t)), sum(brute_count(x, PIECES, LONGEST) for x in w)) for i, t in texts.items()}
    assert {r.doc_id: (r.n_words, r.n_tokens) for r in rows(spark, "op7_token_counts")} == want


def test_op10(spark):
    points = keypoints(rasters(spark.read.parquet(f"{SF}/embeddings.parquet"))).collect()
    ids = [r.vec_id for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id").collect()]
    want = classes(brute_links(points), ids)
    got = {r.vec_id: (r.class_id, r.n_keypoints) for r in rows(spark, "op10_image_copies")}
    assert {i: n for i, (_, n) in got.items()} == {i: sum(p.image_id == i for p in points) for i in ids}
    assert sum(got[i][0] == want[i] for i in ids) >= 0.9 * len(ids) and all(want[i] == want[c] for i, (c, _) in got.items())
