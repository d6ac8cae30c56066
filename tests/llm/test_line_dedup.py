import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from loomgraph.llm.line_dedup import LineRuns, dedup_lines, doc_lines


def brute(rows):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip("\x20\x09\x0a\x0b\x0c\x0d"))
    low = lambda i: float("-inf") if i is None else i
    held = defaultdict(list)
    for n, (i, text) in enumerate(rows):
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= 20:
                held[k].append((low(i), n))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(held.get(key(x), ())) >= 3 and max(held[key(x)])[0] != low(i))]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def check(spark, rows):
    frame = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, n_lines int, kept string")
    got = [(r.doc_id, r.text, r.n_lines_1, r.n_dropped) for r in dedup_lines(frame).collect()]
    order = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(got, key=order) == sorted(brute(rows), key=order)


def test_edges(spark):
    line = "A line of more than twenty characters"
    short = "not twenty long"
    wide = "é" * 19
    rows = [
        (1, f"{line}\n{short}\n\n"), (2, f"  {line.upper()}\t\r\n{short}"), (3, f"{line.lower()}\n{line}\nown"), (4, short), (5, None), (6, ""), (None, f"{line}\n{wide}e"),
        (7, f"{wide}\n{wide}E"), (8, f"{wide}\n{wide}e　"), (9, f"{wide}e\n{wide}"), (9, f"{wide}e"), (10, f" {line}"), (11, "x" * 60000 + "\n" + line),
    ]
    check(spark, rows)
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_random(spark):
    r = random.Random(3)
    lines = [f"line number {k} is long enough to count" for k in range(30)] + ["", "short", "the line that is in nearly every one of them"] * 8
    check(spark, [(i, "\n".join(r.choice(lines) for _ in range(r.randint(0, 8)))) for i in range(120)])


def test_runs(spark):
    """Batches one after the other: each returns the lines that are new; runs are merged level by level."""
    runs, seen = LineRuns(spark, fanout=3), set()
    for b in range(7):
        texts = [(10 * b + k, "\n".join(f"line {(b * 3 + j) % 17} of a text that comes in batches" for j in range(k % 4 + 1))) for k in range(6)]
        docs = spark.createDataFrame(texts, "doc_id long, text string")
        lines = doc_lines(docs)
        own = {(x.h1, x.h2) for x in lines.collect()}
        fresh = {(x.h1, x.h2) for x in runs.add(lines).collect()}
        assert fresh == own - seen
        seen |= own
        assert all(len(level) < 3 for level in runs.levels)
    assert {(x.h1, x.h2) for x in runs.seen().collect()} == seen
    before = runs.seen().agg(F.sum("n_docs"), F.max("max_doc")).first()
    runs.compact(whole=True)
    assert sum(map(len, runs.levels)) == 1 and runs.seen().agg(F.sum("n_docs"), F.max("max_doc")).first() == before
