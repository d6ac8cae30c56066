"""SimHash near-dedup by pigeonhole blocks.

A fingerprint is cut into six blocks.  Two fingerprints that differ in at most three bits agree on three blocks or more, so each
goes out under its twenty choices of three blocks (about 32 bits), and only fingerprints that share a choice are compared.
Equal fingerprints are one node from the start.  A choice that more than ``MOST`` fingerprints share is divided: of four parts of
the bits that it leaves open, such a pair agrees on one.  After three divisions at most 2**15 fingerprints can share all fixed bits, so
what a task compares at once is bounded without leaving out a link.  Within a shared choice links become stars, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, slices, text_bytes, texts, without, written
from .components import connected_components

DISTANCE = 3
SHINGLE = 3
SEED = 42
MOST = 2000
DIVISIONS = 3


def fingerprint(text: bytes) -> int:
    """The 64-bit fingerprint of one text (UTF-8), unsigned."""
    words = text.lower().split()  # of bytes: A-Z, and the white space \x09-\x0D and \x20
    if not words:
        return 0
    line = b" ".join(words)
    digest, seed = xxhash.xxh64_intdigest, SEED
    if len(words) <= SHINGLE:
        return digest(line, seed)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends - sizes + 1)[: 1 - SHINGLE].tolist()
    h = [digest(line[a:b], seed) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)]
    votes = np.zeros(64, np.int64)
    rows = np.array(h, "<u8")
    for i in range(0, len(rows), 4096):
        votes += np.unpackbits(rows[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(rows), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            fps = np.array([fingerprint(x) for x in text_bytes(part.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` (a signed long with the fingerprint's bits) for each row.  Null or empty texts: 0."""
    return in_arrow(texts(docs), _fingerprints, "doc_id long, fp long")


def _mask(bits: list[int]) -> int:
    return sum(1 << i for i in bits)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _parts(bits: list[int], n: int) -> list[list[int]]:
    return [list(map(int, x)) for x in np.array_split(np.array(bits), n)]


def masks() -> list[int]:
    """The twenty choices of three of six blocks."""
    return [_mask([i for block in c for i in block]) for c in combinations(_parts(list(range(64)), 6), 3)]


def divided(mask: int) -> list[int]:
    """``mask`` with each of four parts of its open bits fixed too."""
    rest = [i for i in range(64) if not mask >> i & 1]
    return [mask | _mask(p) for p in _parts(rest, DISTANCE + 1)]


def near(fps: np.ndarray) -> np.ndarray:
    """For each fingerprint of one bucket, the index of its component's first member, linking at ``DISTANCE`` or less."""
    root = np.full(len(fps), -1)
    for i in range(len(fps)):
        if root[i] >= 0:
            continue
        root[i], todo = i, [i]
        while todo:
            rest = np.flatnonzero(root < 0)
            close = rest[np.bitwise_count(fps[rest] ^ fps[todo.pop()]) <= DISTANCE]
            root[close] = i
            todo += close.tolist()
    return root


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of their key: links within each key, as stars or pairs of a short run."""
    held: list[np.ndarray] = []

    def of(key: np.ndarray, fp: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        a, b = [], []
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(key)))
        long = size > 8
        for i, n in zip(first[long], size[long], strict=True):
            root = near(fp[i : i + n])
            a.append(node[i : i + n])
            b.append(node[i : i + n][root])
        for lag in range(1, int(size[~long].max(initial=1))):
            i = np.flatnonzero((key[lag:] == key[:-lag]) & (np.bitwise_count(fp[lag:] ^ fp[:-lag]) <= DISTANCE) & np.repeat(~long, size)[lag:])
            a.append(node[i])
            b.append(node[i + lag])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        return pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], ["a", "b"])

    for batch in batches:
        key, fp, node = (np.concatenate([*([h] if held else []), batch.column(i).to_numpy()]) for i, h in enumerate(held or [None] * 3))
        last = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last key may go on in the next batch
        if last:
            yield of(key[:last], fp[:last].view(np.uint64), node[:last])
        held = [key[last:], fp[last:], node[last:]]
    if held and len(held[0]):
        yield of(held[0], held[1].view(np.uint64), held[2])


def links(nodes: DataFrame, most: int = MOST) -> DataFrame:
    """``a, b``: links between the nodes (``node, fp``; fingerprints differ) that give the same components as all close pairs."""
    spark = nodes.sparkSession
    level = masks()

    def key(rows: DataFrame) -> DataFrame:
        """A key tells masks and fixed bits apart; a collision only adds comparisons."""
        return rows.select(F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), "fp", "node", "mask")

    rows = key(nodes.select("node", "fp", F.explode(F.array(*[F.lit(_signed(m)) for m in level])).alias("mask")))
    found = None
    for division in range(DIVISIONS + 1):
        hot = None
        if division < DIVISIONS:
            hot = written(rows.groupBy("key").count().where(F.col("count") > most).select(F.col("key").alias("hot")), "hot-keys")
            if hot.isEmpty():
                hot = None
        cold = rows if hot is None else rows.join(hot, F.col("key") == F.col("hot"), "left_anti")
        own = cold.select("key", "fp", "node").repartition("key").sortWithinPartitions("key").mapInArrow(_links, "a long, b long")
        found = own if found is None else found.union(own)
        if hot is None:
            return found
        finer = spark.createDataFrame([(_signed(m), [_signed(d) for d in divided(m)]) for m in level], "of long, finer array<long>")
        kept = rows.join(hot, F.col("key") == F.col("hot"), "left_semi").join(F.broadcast(finer), F.col("mask") == F.col("of"))
        rows = key(kept.select("node", "fp", F.explode("finer").alias("mask")))
        level = [d for m in level for d in divided(m)]
    return found


def near_duplicates(docs: DataFrame, most: int = MOST) -> DataFrame:
    """``doc_id, fp, component_id`` for each row of ``docs``; the component is the smallest ``doc_id`` that links reach.

    Fingerprints that differ in three bits or fewer link, equal ones always; null, empty and blank texts have fingerprint 0,
    which links like any other.  A null ``doc_id`` links nothing and has no component, yet keeps its row.  Rows that repeat an id each have theirs.
    Other columns are ignored, texts of any length read whole; no documents, no rows.
    """
    fps = written(fingerprints(docs), "fingerprints")
    nodes = written(fps.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    roots = connected_components(links(nodes, most))
    named = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    done = fps.join(named, "fp", "left")
    return done.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def deduplicated(docs: DataFrame, most: int = MOST) -> DataFrame:
    """``docs`` with one row of each component: the one of the smallest ``doc_id``.

    Rows that share a ``doc_id`` are one document, of which the row with the smallest text stays.  Rows without an id stay.  All columns stay,
    whatever their names; no documents, no rows.
    """
    near = written(near_duplicates(docs, most), "near")
    once = without(docs, near.where("component_id <> doc_id").select("doc_id"))
    again = written(near.where("component_id = doc_id").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    if again.isEmpty():
        return once
    # Ids that recur are rare; only their rows are dealt by id.
    row = F.struct(*[once[c] for c in docs.columns])
    recur = once.select(once["doc_id"].cast("long").alias("of"), row.alias("row"), once["text"].alias("text")).join(again, F.col("of") == F.col("doc_id"), "left_semi")
    first = recur.groupBy("of").agg(F.min_by("row", F.coalesce("text", F.lit(""))).alias("row")).select("row.*")
    return without(once, again).unionByName(first)
