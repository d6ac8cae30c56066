"""Not-modified revisits of web archives: an as-of join by canonical URL.

A revisit record (the answer 304) has no body.  It stands for the latest full response of the same canonical URL that was
captured before it, if the validators agree, with the headers that a 304 may renew.

All records are dealt by ranges of (URL, time), so a URL with a third of all records spans many ranges.  Within a range a window
carries the last response forward; between ranges go only each URL's last responses, one a URL and range.  Everything is DataFrame
operations; records are sorted once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

#: Query parameters that name no resource (fixed values).
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)"
#: Header fields that a 304 may renew (RFC 9110, 15.4.5, and Last-Modified), lower case (fixed values).
RENEWED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Rows of a range, about.
RANGE_ROWS = 200_000


def canonical_url(url: Column) -> Column:
    """Host in lower case without user, ``www.`` and default port, path without closing slashes, other parameters sorted; no scheme, no fragment."""
    rest = F.regexp_replace(F.regexp_extract(F.trim(url), "^[^#]*", 0), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(rest, "^[^/?]*", 0), "^.*@", ""))
    host = F.regexp_replace(F.regexp_replace(host, "^www[.]", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/+$", "")
    params = F.array_sort(F.filter(F.split(F.regexp_extract(rest, "^[^?]*[?](.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(F.lit("")))


def _weak(etag: Column) -> Column:
    """Entity tags compare weakly: without their W/."""
    return F.regexp_replace(F.trim(etag), "^W/", "")


def merged_headers(response: Column, revisit: Column) -> Column:
    """The response's header fields (lower-case names), those of ``RENEWED`` replaced by the revisit's where it has them."""

    def low(m: Column) -> Column:
        """Of names that differ only in case, the value of the one that sorts last: maps keep no order of their own."""
        all_of = F.array_sort(F.coalesce(F.map_entries(m), F.array().cast("array<struct<key:string,value:string>>")))
        lower = F.transform(all_of, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
        later = lambda e, i: F.exists(F.slice(lower, i + 2, F.size(lower)), lambda x: x["key"] == e["key"])
        return F.map_from_entries(F.filter(lower, lambda e, i: ~later(e, i)))

    fresh = F.map_filter(low(revisit), lambda k, v: k.isin(*RENEWED) & v.isNotNull())
    return F.map_concat(F.map_filter(low(response), lambda k, v: ~F.array_contains(F.map_keys(fresh), k)), fresh)


def resolved(records: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """A row for each revisit of ``records``: ``record_id, url_key, response_id, outcome, headers``.

    ``records``: ``record_id`` long, ``url``, ``ts`` (any ordered type), ``kind`` ("response", "revisit"; others are left out), ``etag``,
    ``last_modified``, ``headers`` map; other columns are ignored.  Earlier means a smaller ``ts``; of responses with the same ``ts`` the largest
    ``record_id`` is the latest.  Outcomes: "resolved" (entity tags, or else the dates, are equal), "unchecked" (no validator on both
    sides), "changed" (they differ; no headers), "missing" (no earlier response, or a null url or ts; no response_id, no headers).
    Of header names within a record that differ only in case, the one that sorts last counts.  Repeated revisits each have their row; no records, no rows.
    """
    body = F.struct("record_id", "etag", "last_modified", "headers")
    kind = F.col("kind")
    own = records.select("record_id", "url", "ts", "kind", "etag", "last_modified", "headers").where(kind.isin("response", "revisit"))
    plain = own.select(canonical_url(F.col("url")).alias("url_key"), "ts", (kind == "response").cast("int").alias("full"), "record_id", body.alias("own"))
    timed = plain.where(F.col("url_key").isNotNull() & F.col("ts").isNotNull())
    order = ["ts", "full", "record_id"]  # at the same time revisits come first: a response isn't earlier than they
    ranges = max(1, -(-timed.count() // range_rows))
    dealt = timed.repartitionByRange(ranges, "url_key", *order).sortWithinPartitions("url_key", *order).withColumn("part", F.spark_partition_id())
    dealt = written(dealt, "records")
    before = Window.partitionBy("part", "url_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    response = F.when(F.col("full") == 1, F.col("own"))
    here = dealt.withColumn("here", F.last(response, ignorenulls=True).over(before)).where("full = 0")
    # What a range hands on: a URL's last response in it.  Only URLs that span ranges have several rows here.
    tails = dealt.where("full = 1").groupBy("url_key", "part").agg(F.max_by("own", F.struct("ts", "record_id")).alias("tail"))
    heads = dealt.groupBy("url_key", "part").agg(F.min("full").alias("low")).join(tails, ["url_key", "part"], "left")
    earlier = Window.partitionBy("url_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = heads.withColumn("carried", F.last("tail", ignorenulls=True).over(earlier)).where("low = 0 AND carried IS NOT NULL").select("url_key", "part", "carried")
    found = here.join(carried, ["url_key", "part"], "left").withColumn("of", F.coalesce("here", "carried")).select("url_key", "own", "of")
    lost = plain.where("full = 0 AND (url_key IS NULL OR ts IS NULL)").select("url_key", "own", F.lit(None).cast(plain.schema["own"].dataType).alias("of"))
    rows = found.unionByName(lost)
    tags, dates = (rows["own"][c].isNotNull() & rows["of"][c].isNotNull() for c in ("etag", "last_modified"))
    same = F.when(tags, _weak(rows["own"]["etag"]) == _weak(rows["of"]["etag"])).when(dates, rows["own"]["last_modified"] == rows["of"]["last_modified"])
    outcome = F.when(rows["of"].isNull(), "missing").when(same.isNull(), "unchecked").when(same, "resolved").otherwise("changed")
    out = rows.select(F.col("own.record_id").alias("record_id"), "url_key", F.col("of.record_id").alias("response_id"), outcome.alias("outcome"), "own", "of")
    headers = F.when(F.col("outcome").isin("resolved", "unchecked"), merged_headers(F.col("of.headers"), F.col("own.headers")))
    return out.select("record_id", "url_key", "response_id", "outcome", headers.alias("headers"))


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Archive records made from a table of pages: for each page a response, and later a revisit that carries the page's entity tag.

    Page p is captured at 10 p and revisited at 10 p + 5 + 10 (7919 p mod 1000), when another page of its URL may have come between.
    """
    page = F.col("page_id").cast("long")
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    base = pages.select(page.alias("p"), "url", tag.alias("tag"), F.length(F.coalesce("html", F.lit(""))).cast("string").alias("size"))
    later = F.col("p") * 10 + 5 + 10 * ((F.col("p") * 7919) % 1000)
    fields = lambda *kv: F.create_map(*[x if isinstance(x, Column) else F.lit(x) for x in kv])
    response = base.select((F.col("p") * 2).alias("record_id"), "url", (F.col("p") * 10).alias("ts"), F.lit("response").alias("kind"), F.col("tag").alias("etag"), fields("Content-Type", "text/html", "Content-Length", F.col("size"), "ETag", F.col("tag"), "Date", (F.col("p") * 10).cast("string"), "Cache-Control", "max-age=60").alias("headers"))
    weak = F.concat(F.lit("W/"), F.col("tag"))
    revisit = base.select((F.col("p") * 2 + 1).alias("record_id"), "url", later.alias("ts"), F.lit("revisit").alias("kind"), weak.alias("etag"), fields("content-length", "0", "etag", weak, "date", later.cast("string"), "x-cache", "hit").alias("headers"))
    return response.unionByName(revisit).withColumn("last_modified", F.lit(None).cast("string"))
