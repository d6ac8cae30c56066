import random

from pyspark.sql import functions as F

from loomgraph.llm.warc import RENEWED, canonical_url, resolved

SCHEMA = "record_id long, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>, outcome string"


def brute(rows, key):
    out = {}
    for r in (x for x in rows if x[3] == "revisit"):
        rid, url, ts = r[:3]
        full = [x for x in rows if x[3] == "response" and None not in (url, ts, x[1], x[2]) and key[x[1]] == key[url] and x[2] < ts]
        if not full:
            out[rid] = (None, "missing", None)
            continue
        o = max(full, key=lambda x: (x[2], x[0]))
        bare = lambda t: t.strip().removeprefix("W/")
        same = bare(r[4]) == bare(o[4]) if r[4] is not None and o[4] is not None else r[5] == o[5] if r[5] is not None and o[5] is not None else None
        low = lambda h: {k.lower(): v for k, v in sorted((h or {}).items(), key=lambda e: e[0])}
        headers = None if same is False else low(o[6]) | {k: v for k, v in low(r[6]).items() if k in RENEWED and v is not None}
        out[rid] = (o[0], {None: "unchecked", True: "resolved", False: "changed"}[same], headers)
    return out


def test_canonical_urls(spark):
    same = ["http://www.A.com/x/?b=2&a=1&utm_source=q#f", "https://user:p@a.com:443/x?a=1&b=2", "a.com/x/?ref=z&b=2&&a=1", " HTTP://A.COM:80/x?a=1&b=2 "]
    rows = spark.createDataFrame([(u,) for u in same] + [("http://a.com/",), ("http://m.a.com",), (None,), ("",)], "u string").select(canonical_url(F.col("u"))).collect()
    assert [r[0] for r in rows] == ["a.com/x?a=1&b=2"] * 4 + ["a.com", "m.a.com", None, ""]


def test_against_brute_force(spark):
    r = random.Random(5)
    urls = ["http://a.com/hot"] * 8 + ["https://www.a.com/hot/", "http://b.org/", "http://b.org/?ref=1", "http://c.net/x?p=1", None, ""]
    rows = []
    for i in range(600):
        kind = r.choice(["response", "revisit", "revisit", "request"])
        tag = r.choice([None, '"1"', 'W/"1"', '"2"'])
        headers = r.choice([None, {}, {"ETag": tag, "Date": str(i), "X-A": "1"}, {"etag": "old", "Date": "first", "ETAG": tag, "date": str(i)}, {"Content-Type": "t", "Content-Length": str(i), "CACHE-control": None}])
        rows.append((i, r.choice(urls), r.choice([None, *range(40)]), kind, tag, r.choice([None, "mon", "tue"]), headers, "clash"))
    frame = spark.createDataFrame(rows, SCHEMA)
    key = {x.url: x.k for x in frame.select("url", canonical_url(F.col("url")).alias("k")).distinct().collect()}
    want = brute(rows, key)
    for size in (17, 200_000):
        got = {x.record_id: (x.response_id, x.outcome, x.headers) for x in resolved(frame, range_rows=size).collect()}
        assert got == want
    assert resolved(frame.where("false")).collect() == []
