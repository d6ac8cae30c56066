import re
import time

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import token_counts as token_counts_module
from loomgraph.llm.token_counts import LAST, Automaton, pieces_of, token_counts, word_bounds
from loomgraph.llm.words import joined

SPEC = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
PIECES = set(pieces_of(SPEC))
LONGEST = max(map(len, PIECES))


def brute_words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w.encode() for w in re.findall(r"[a-z\x80-\U0010ffff]+|[0-9]|[^a-z0-9\x80-\U0010ffff\x20\x09-\x0d]+", low)]


def brute_count(word, pieces, longest):
    symbols = [*word[:-1], word[-1] + LAST]
    n = i = 0
    while i < len(symbols):
        k = next((k for k in range(min(longest, len(symbols) - i), 0, -1) if tuple(symbols[i : i + k]) in pieces), 0)
        if not k:
            return 1
        n, i = n + 1, i + k
    return n


@settings(max_examples=150, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=5), min_size=1, max_size=12), st.sets(st.text("abc", min_size=1, max_size=4), max_size=8), st.lists(st.text("abc", min_size=1, max_size=12), max_size=20))
def test_automaton(inner, final, words):
    pieces = {tuple(x.encode()) for x in inner} | {(*x.encode()[:-1], x.encode()[-1] + LAST) for x in final}
    buf, offsets = joined(pa.array(words, pa.string()))
    got = Automaton(sorted(pieces)).counts(buf, offsets[:-1], offsets[1:]).tolist()
    assert got == [brute_count(w.encode(), pieces, 6) for w in words]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aB 1!,\n\té") | st.characters(exclude_categories=["Cs"]), max_size=12), max_size=6))
def test_words(texts):
    buf, offsets = joined(pa.array(texts, pa.string()))
    got = [buf[a:b].tobytes() for a, b in zip(*word_bounds(buf, offsets), strict=True)]
    assert got == [w for t in texts for w in brute_words(t)]


@settings(max_examples=100, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=5), min_size=1, max_size=12), st.lists(st.text("abc", min_size=1, max_size=30), max_size=8))
def test_long_words(inner, words):
    """Words one by one as side by side."""
    pieces = {tuple(x.encode()) for x in inner} | {(*x.encode()[:-1], x.encode()[-1] + LAST) for x in inner}
    buf, offsets = joined(pa.array(words, pa.string()))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(token_counts_module, "LONG", 5)
        assert Automaton(sorted(pieces)).counts(buf, offsets[:-1], offsets[1:]).tolist() == [brute_count(w.encode(), pieces, 6) for w in words]


def test_ten_megabytes_without_a_space():
    automaton, took = Automaton(sorted(PIECES)), []
    for n in (1_000_000, 10_000_000):
        buf, offsets = joined(pa.array(["abcdefghij" * (n // 10)]))
        began = time.perf_counter()
        assert automaton.counts(buf, *word_bounds(buf, offsets))[0] > n // 20
        took.append(time.perf_counter() - began)
    assert took[1] < 30 * took[0]


def test_rows(spark):
    texts = ["Internationalization isn't x1y22 -- ok!!", None, "", " \n ", "a" * 30000, "É日本語 ſK", "w " * 5000]
    docs = spark.createDataFrame([(i if i else None, t, "c", 5) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string, n_words_1 int")
    got = [(r.n_words, r.n_tokens_1, r.n_tokens) for r in token_counts(docs, SPEC).collect()]
    assert got == [(len(brute_words(t)), sum(brute_count(w, PIECES, LONGEST) for w in brute_words(t)), "c") for t in texts]
    assert token_counts(docs.where("false"), SPEC).collect() == []


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for r in token_counts(docs, SPEC).collect():
        assert r.n_tokens == sum(brute_count(w, PIECES, LONGEST) for w in brute_words(r.text))
