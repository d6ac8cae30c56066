"""One query for each operator of this subpackage, over whole tables; SQL where DuckDB can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontaminate import contamination
from .image_copies import copy_classes, rasters
from .line_dedup import dedup_lines
from .quality import THRESHOLD, held_out, scored, train
from .secrets_scan import Scanner, found_findings, made_findings, secrets
from .sentencepiece_wfst import encoded, model_bytes
from .simhash import near_duplicates
from .token_counts import token_counts
from .token_files import token_digests, write_token_files
from .warc import records_of_pages, resolved


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = near_duplicates(table(spark, sf_dir, "documents"))
    return done.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = encoded(docs, model_bytes(public_tokenizers.path("piece_bpe_32k.model")), ["n_tokens", "ids_crc32", "decoded"], with_text=False)
    return done.select("doc_id", "n_tokens", "ids_crc32", F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    done = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return done.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = secrets(docs, Scanner().fit(made_findings() + found_findings(docs, held_out(F.col("doc_id")))))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = joined(F.filter("secrets", lambda s: s["kind"] != "model"))
    return done.select("doc_id", *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")], F.sha2(base, 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"), count("model").alias("n_model"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL_5 = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
often AS (SELECT key, max(doc_id) AS max_doc FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.*, often.key IS NOT NULL AND k.doc_id <> often.max_doc AS gone FROM k LEFT JOIN often USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""

def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = f.read()
    path, manifest = write_token_files(table(spark, sf_dir, "documents"), spec)
    return token_digests(spark, path, manifest)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = f.read()
    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), spec).drop("text")


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = resolved(records_of_pages(table(spark, sf_dir, "pages")))
    lines = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
    page = lambda c: F.floor(F.col(c) / 2).cast("long")
    return done.select(page("record_id").alias("page_id"), "url_key", page("response_id").alias("response_page_id"), "outcome", F.sha2(lines, 256).alias("headers_sha256"))


SQL_8 = r"""
WITH p AS (
  SELECT page_id AS p, '"' || md5(coalesce(html, '')) || '"' AS tag, length(coalesce(html, ''))::VARCHAR AS size,
    regexp_replace(regexp_extract(trim(url), '^[^#]*', 0), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest
  FROM pages),
q AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_replace(regexp_extract(rest, '^[^/?]*', 0), '^.*@', '')), '^www[.]', ''), ':(80|443)$', '')
      || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS place,
    list_sort(list_filter(string_split(regexp_extract(rest, '^[^?]*[?](.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)'))) AS params
  FROM p),
r AS (SELECT *, place || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS url_key, p * 10 AS ts, p * 10 + 5 + 10 * ((p * 7919) % 1000) AS later FROM q),
j AS (SELECT v.p, v.url_key, v.tag, v.later, o.p AS op, o.tag AS otag, o.size AS osize FROM r v ASOF LEFT JOIN r o ON v.url_key = o.url_key AND v.later > o.ts)
SELECT p AS page_id, url_key, op AS response_page_id,
  CASE WHEN op IS NULL THEN 'missing' WHEN tag = otag THEN 'resolved' ELSE 'changed' END AS outcome,
  CASE WHEN tag = otag THEN sha256('cache-control: max-age=60' || chr(10) || 'content-length: ' || osize || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || later || chr(10) || 'etag: W/' || tag) END AS headers_sha256
FROM j
"""


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return done.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


SQL_9 = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
items AS (
  SELECT item_id, least(len(w), 13) AS n, array_to_string(list_slice(w, p, p + least(len(w), 13) - 1), ' ') AS win
  FROM (SELECT *, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS p FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM items),
docs AS (
  SELECT doc_id, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM dw, sizes WHERE len(w) >= n)),
found AS (SELECT DISTINCT doc_id, item_id, p, items.n FROM docs JOIN items USING (win, n)),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) AS k FROM found) GROUP BY doc_id),
own AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN own USING (doc_id)
"""

def op10_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copy_classes(rasters(table(spark, sf_dir, "embeddings"))).withColumnRenamed("image_id", "vec_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_quality": op3_quality,
    "op4_secrets": op4_secrets,
    "op5_line_dedup": op5_line_dedup,
    "op6_token_files": op6_token_files,
    "op7_token_counts": op7_token_counts,
    "op8_warc_revisits": op8_warc_revisits,
    "op9_decontamination": op9_decontamination,
    "op10_image_copies": op10_image_copies,
}

SQL: dict[str, str] = {
    "op5_line_dedup": SQL_5,
    "op8_warc_revisits": SQL_8,
    "op9_decontamination": SQL_9,
}
