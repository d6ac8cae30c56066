import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import sentencepiece_wfst
from loomgraph.llm.sentencepiece_wfst import BPE, Model, encoded, merged, model_bytes

RAW = model_bytes(public_tokenizers.path("piece_bpe_32k.model"))
own = Model(RAW)
library = sentencepiece.SentencePieceProcessor(model_proto=RAW)

TEXT = st.text(st.sampled_from("aaabeth ▁.\n\té=0<x") | st.characters(exclude_categories=["Cs"]), max_size=60)


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_as_the_library(text):
    assert own.encode(text) == library.encode(text)
    assert own.decode(library.encode(text)) == text.replace("▁", " ")


@settings(max_examples=200, deadline=None)
@given(st.text(" ab▁\0", max_size=12), st.booleans(), st.booleans(), st.booleans())
def test_normaliser(text, prefix, squeeze, escape):
    flags = Model(model([("<unk>", 0.0, 2), ("a", -1.0, 1)], 1))
    flags.prefix, flags.squeeze, flags.escape = prefix, squeeze, escape
    assert flags.normalised(text) == sentencepiece_wfst.transduced(text, sentencepiece_wfst.normaliser(prefix, squeeze, escape))


def test_long_chunks():
    for text in ["x" * 3000, "=" * 999 + " " * 500 + "e", "théâtre" * 400, "日本" * 300]:
        assert own.encode(text) == library.encode(text)


@settings(max_examples=60, deadline=None)
@given(st.text("abéthr日", min_size=1, max_size=300), st.integers(16, 40))
def test_windows(text, window):
    """A long chunk's windows, cut anywhere, against the library."""
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(sentencepiece_wfst, "WINDOW", window)
        patch.setattr(sentencepiece_wfst, "LONG", 3)
        assert Model.encode(own, text) == library.encode(text)
        own.chunks.clear()


def test_a_million_characters():
    """Without a space, in a time that follows the length."""
    took = []
    for n in (100_000, 1_000_000):
        text = "ศกดฟหาสวงรทเ" * (n // 12)
        began = time.perf_counter()
        assert own.decode(own.encode(text)) == text
        took.append(time.perf_counter() - began)
    assert took[1] < 30 * took[0]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", min_size=1, max_size=9))
def test_seams_are_what_merging_leaves(text):
    """On a small vocabulary, against the merges themselves."""
    pieces = ["a", "b", "c", "ab", "bc", "abc", "aa", "aab", "ca", "caab", "bb"]
    score = {p: -float(n) for n, p in enumerate(pieces)}
    assert [SMALL.pieces[i][0] for i in SMALL.encode_chunks([text])[0]] == merged(list(text), score)[0]


def field(number, value):
    size = len(value)
    out = bytes([number << 3 | 2])
    while size > 127:
        out += bytes([size & 127 | 128])
        size >>= 7
    return out + bytes([size]) + value


def model(pieces, kind):
    import struct

    raw = b"".join(field(1, field(1, p.encode()) + b"\x15" + struct.pack("<f", s) + bytes([0x18, t])) for p, s, t in pieces)
    return raw + field(2, bytes([0x18, kind])) + field(3, bytes([0x18, 0, 0x20, 0, 0x28, 1]))


SMALL = Model(model([("<unk>", 0.0, 2)] + [(p, -float(n), 1) for n, p in enumerate(["a", "b", "c", "ab", "bc", "abc", "aa", "aab", "ca", "caab", "bb"])], BPE))


@settings(max_examples=200, deadline=None)
@given(st.text("abz", min_size=1, max_size=12))
def test_unigram_paths_are_best(text):
    pieces = {"a": -3.0, "b": -2.5, "ab": -4.0, "aba": -5.25, "bb": -4.5}
    small = Model(model([("<unk>", 0.0, 2)] + [(p, s, 1) for p, s in pieces.items()], 1))
    ids, _ = small.encode_chunks([text])
    unknown = min(pieces.values()) - 10
    best = [0.0] + [-np.inf] * len(text)
    for e in range(1, len(text) + 1):
        for s in range(e):
            p = text[s:e]
            best[e] = max(best[e], best[s] + (pieces[p] if p in pieces else unknown if e - s == 1 and p == "z" else -np.inf))
    got, z = 0.0, 0
    for i in ids:
        if i == 0:
            z += 1
        else:
            got += small.pieces[i][1]
    assert abs(got + text.count("z") * unknown - best[-1]) < 1e-9 and (z > 0) == ("z" in text)


def test_rows(spark):
    texts = [None, "", " ", "Some  text▁\n", "y" * 20000, "w " * 20000, "Some  text▁\n"]
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    rows = {r.doc_id: r for r in encoded(docs, RAW).collect()}
    for i, t in enumerate(texts):
        want = library.encode(t or "")
        assert (rows[i].ids_1, rows[i].n_tokens, rows[i].ids_crc32) == (want, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        assert rows[i].decoded == (t or "").replace("▁", " ") and rows[i].ids == "c"
    slim = encoded(docs, RAW, ["n_tokens", "round_trip"], with_text=False)
    assert slim.columns == ["doc_id", "ids", "n_tokens", "round_trip"]
    assert {r.doc_id: r.n_tokens for r in slim.collect()} == {i: r.n_tokens for i, r in rows.items()} and all(r.round_trip for r in slim.collect())
    assert encoded(docs.where("false"), RAW).collect() == []


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for r in encoded(docs, RAW).collect():
        assert r.ids == library.encode(r.text) and r.decoded == r.text


def test_other_models():
    with pytest.raises(ValueError):
        Model(model([("<unk>", 0.0, 2)], 3))
