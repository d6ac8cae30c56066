import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.llm.quality import held_out
from loomgraph.llm.secrets_scan import CANDIDATE, HEX, KINDS, LEFT, MAX_ROWS, RECALL, RIGHT, Scanner, base_spans, candidates, found_findings, labelled_runs, made_findings, runs, secrets, spans_of

KEY = "|".join("".join(f"[{c.lower()}{c.upper()}]" for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"


def brute_base(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(f"({KEY})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "TOKEN", "ſecret", "toKen", "api_key", "ApiKey", "=", ":", " ", '"', "'", "AKIA", "abc", "0123456789abcdef", "Z9", "é", ".", "\n"]), max_size=14).map("".join))
def test_base(text):
    assert base_spans(text) == brute_base(text)


@settings(max_examples=200, deadline=None)
@given(st.text("a1Z =:", max_size=80), st.sampled_from(["", "password=aaaaaaaaaaaa", "AKIA" + "Z" * 14]), st.text("a1/ ", max_size=60))
def test_candidates(a, b, c):
    text = a + b + c
    base = base_spans(text)
    want = [m.span() for m in CANDIDATE.finditer(text) if re.search("[0-9]", m[0]) and all(e <= m.start() or s >= m.end() for s, _, e in base)]
    assert candidates(text, base) == want


@pytest.fixture(scope="module")
def scanner():
    return Scanner().fit(made_findings())


def test_held_out_findings(scanner):
    rows = made_findings(1500, seed=3)
    got = scanner.scores([(a[-LEFT:], b, c[:RIGHT]) for a, b, c, _ in rows]) >= scanner.threshold
    label = np.array([x[3] for x in rows]) == 1
    assert got[label].mean() > RECALL - 0.03 and got[~label].mean() < 0.02


def test_scores_stand_alone(scanner):
    """A candidate's score doesn't depend on what it is computed with."""
    rows = [(a, b, c) for a, b, c, _ in made_findings(300, seed=8)]
    together = scanner.raw(rows)
    assert np.allclose(together, [scanner.raw([x])[0] for x in rows], atol=1e-4)


def test_one_class():
    with pytest.raises(ValueError):
        Scanner().fit([("", "a" * 20 + "1", "", 1)])


def test_rows(spark, scanner):
    texts = [None, "", "pre password=0123456789abcdef0 é", "clean words only", "é ghp_" + "aB3dE6gH9j" * 3 + "aB3dE6 end", "y" * 50000 + "1", "4111111111111111 " * 3, "token: token: abcdefghijklmnop"]
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, secrets string")
    rows = {r.doc_id: [(s["start"], KINDS.index(s["kind"]), s["end"]) for s in r.secrets_1] for r in secrets(docs, scanner).collect()}
    assert rows == {i: [x[:3] for x in spans_of(t or "", scanner)] for i, t in enumerate(texts)}
    assert rows[2] == [(4, 0, 30), (13, 2, 30)] and rows[4] == [(2, 3, 42)] and rows[0] == rows[1] == rows[3] == []
    assert secrets(docs.where("false"), scanner).collect() == []


def test_whole_table(spark, scanner):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for r in secrets(docs, scanner).collect():
        assert [(s["start"], KINDS.index(s["kind"]), s["end"]) for s in r.secrets if s["kind"] != "model"] == brute_base(r.text or "")


def test_every_run_is_scored(scanner):
    """Short secrets, those without a digit, and keys around a run of hexadecimal digits are found as a whole."""
    key = "qZ7xKp" + "0123456789abcdef" + "Rt9vWm"
    for before, secret in (("pwd: ", "Xk9mQ2vL8pR4t"), ("Authorization: Bearer ", "QwZxKjHgTrYvBnMpLsDfCqWz"), ("passphrase: ", "kelvon-tarsim-bodrig-pelluna"), ("key: ", key)):
        text = "some words " + before + secret + " and more"
        at = len("some words " + before)
        assert (at, at + len(secret)) in runs(text, base_spans(text))
        assert (at, 3, at + len(secret)) in [x[:3] for x in spans_of(text, scanner)], secret
    assert [x[:3] for x in spans_of("key: " + key, scanner)] == [(5, 3, 5 + len(key)), (11, 2, 27)]
    assert all(len(b) < 16 or not re.search("[0-9]", b) or HEX.search(b) for b in ("Xk9mQ2vL8pR4t", key))
    short = [x for x in made_findings(1500, seed=3) if x[3] and (len(x[1]) < 16 or not re.search("[0-9]", x[1]))]
    assert len(short) > 50 and np.mean(scanner.scores([x[:3] for x in short]) >= scanner.threshold) > RECALL - 0.05


def test_findings_in_documents(spark):
    """Learnt from the documents outside the held-out fold; of those in it, patterns' findings are recognised and plain runs left alone."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    found = found_findings(docs, held_out(F.col("doc_id")))
    assert found == found_findings(docs.repartition(7), held_out(F.col("doc_id")))
    assert {x[3] for x in found} == {0, 1} and max(sum(x[3] == y for x in found) for y in (0, 1)) <= MAX_ROWS
    scanner = Scanner().fit(made_findings() + found)
    rows = [x for r in docs.where(held_out(F.col("doc_id"))).collect() for x in labelled_runs(r.text or "", 5)]
    got = scanner.scores([x[:3] for x in rows]) >= scanner.threshold
    label = np.array([x[3] for x in rows]) == 1
    assert got[label].mean() > 0.75 and got[~label].mean() < 0.01


def test_findings_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (None, "token=abcdefghijklmnop"), (2, ""), (3, "secret: abcdefghijkl0 and something longer"), (3, "secret: abcdefghijkl0 and something longer")], "doc_id long, text string")
    assert found_findings(docs, F.lit(False)) == found_findings(docs.where("doc_id = 3"), F.lit(False))
    assert [(x[1], x[3]) for x in found_findings(docs, F.lit(False))] == [("something", 0), ("abcdefghijkl0", 1)]
    assert found_findings(docs.where("false"), F.lit(False)) == []
