import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer as Library

from loomgraph.llm.token_files import BLOCK, TokenFile, Tokenizer, encode_file, read_token_files, token_digests, write_token_files

SPEC = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=700), max_size=8))
def test_round_trip(docs):
    sizes = np.array([len(d) for d in docs], np.int64)
    ids = np.array([x for d in docs for x in d], np.int64)
    file = TokenFile(encode_file([None if i == 2 else i * 7 for i in range(len(docs))], sizes, ids))
    assert file.ids().tolist() == ids.tolist()
    assert [file.document(k).tolist() for k in range(len(docs))] == docs
    assert file.doc_ids == [None if i == 2 else i * 7 for i in range(len(docs))]


def test_blocks():
    r = np.random.default_rng(0)
    ids = np.concatenate([np.full(BLOCK, 9), r.integers(0, 49408, 5 * BLOCK + 3), r.integers(0, 2**32, 50)])
    raw = encode_file([1], np.array([len(ids)]), ids)
    assert TokenFile(raw).ids(BLOCK - 2, 3 * BLOCK + 1).tolist() == ids[BLOCK - 2 : 3 * BLOCK + 1].tolist()
    assert len(raw) < 2.4 * len(ids)  # against 4 bytes an id
    with pytest.raises(ValueError):
        TokenFile(b"x" + raw[1:])


own, library = Tokenizer(SPEC), Library.from_str(SPEC)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("abZ .,'s!1\n\t\x1c\x1e  \x85éΣ̀ſK<|endoftext|>") | st.characters(exclude_categories=["Cs"]), max_size=40))
def test_as_the_library(text):
    assert own.encode_all([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def brute(docs):
    out, start = {}, 0
    for i, text in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        out[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    return out


def test_files(spark):
    docs = [(5, "Some text. And more, here!"), (3, None), (None, "no id"), (9, ""), (1, "<|endoftext|> inside"), (2, "word " * 20000), (4, "x" * 5000)]
    frame = spark.createDataFrame([(*d, 0, "z") for d in docs], "doc_id long, text string, start int, file string")
    path, manifest = write_token_files(frame, SPEC, task_rows=2, file_ids=500)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_digests(spark, path, manifest).collect()} == brute(docs)
    ids = {r.doc_id: r.ids for r in read_token_files(spark, path).collect()}
    assert ids[5] == library.encode(docs[0][1], add_special_tokens=False).ids + [1] and ids[3] == [1]
    path, manifest = write_token_files(frame.where("false"), SPEC)
    assert token_digests(spark, path, manifest).collect() == []


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    path, manifest = write_token_files(docs, SPEC, task_rows=60)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_digests(spark, path, manifest).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])
