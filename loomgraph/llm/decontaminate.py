"""Benchmark decontamination over a distributed positional inverted index.

The index is dealt by document: each row is a segment of consecutive documents with, for each term, the sorted list of its
positions (delta-coded, compressed).  No posting is shuffled, a frequent term's list is never in one place, and a segment that
is lost with its executor is built anew from its own documents.  It is built once; test items are searched in blocks of a stated size.
Within a segment, a window's lists are intersected in order of length, rarest first, each shifted by the term's offset in the window.
Positions count words through the segment with a gap after each document that no window or slop bridges.

As no query can look up another term, the index of a search keeps the terms of its test items only, if they are at most ``VOCABULARY``; else, as
with ``vocabulary=None``, it keeps all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, give_back, in_arrow, slices, texts, without, written
from .words import bounds, hashes, joined, word_counts

WINDOW = 13
#: Windows that are searched at once; a larger benchmark is searched in several passes, so what is sent to executors is bounded.
BLOCK_WINDOWS = 100_000
#: Terms that are sent to executors at once (some 20 MB); it changes the index's size, not what is found.
VOCABULARY = 1_000_000
SEGMENT_BYTES = 2 << 20
GAP = 64
INDEX = "doc_ids array<bigint>, n_words array<int>, terms array<string>, sizes array<int>, postings binary"
MATCHES = "array<struct<item_id:string,start:int,n_words:int>>"
FOUND = f"segment long, place int, doc_id long, n_words long, matches {MATCHES}"


def words_of(text: str | None) -> list[str]:
    """The words of one text; the reference form of what the index does on bytes."""
    if not text:
        return []
    buf, offsets = joined(pa.array([text]))
    raw = buf.tobytes()
    return [raw[a:b].decode() for a, b in zip(*bounds(buf, offsets), strict=True)]


class Vocabulary:
    """Terms by hash; ``find`` gives each word's term or -1, and compares bytes, so that no hash collision counts."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        column = pa.array(terms, pa.large_string()).cast(pa.large_binary())
        self.buf, self.offsets = joined(column)
        h = hashes(self.buf, self.offsets[:-1], self.offsets[1:])
        self.order = np.argsort(h)
        self.hash = h[self.order]
        # A table by the top bits says at once that most words are no term.
        self.top = np.zeros(1 << 20, bool)
        self.top[(h >> np.uint64(44)).astype(np.int64)] = True

    def find(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        found = np.full(len(start), -1, np.int32)
        if not len(self.terms) or not len(start):
            return found
        h = hashes(buf, start, end)
        maybe = np.flatnonzero(self.top[(h >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hash, h[maybe]), len(self.hash) - 1)
        same = self.hash[at] == h[maybe]
        maybe, term = maybe[same], self.order[at[same]]
        own = np.diff(self.offsets)[term]
        same = own == (end - start)[maybe]
        maybe, term, own = maybe[same], term[same], own[same]
        for n in np.unique(own):
            k = np.flatnonzero(own == n)
            step = np.arange(n)
            equal = (buf[start[maybe[k]][:, None] + step] == self.buf[self.offsets[term[k]][:, None] + step]).all(1)
            found[maybe[k[equal]]] = term[k[equal]]
        return found


def _pack(positions: np.ndarray, sizes: np.ndarray) -> bytes:
    """Deltas within each list as four planes of bytes, compressed; the high planes are nearly all zero."""
    delta = np.diff(positions, prepend=0).astype(np.int64)
    first = np.cumsum(sizes) - sizes
    first = first[sizes > 0]
    delta[first] = positions[first]
    planes = delta.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(postings: bytes, sizes: np.ndarray) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(postings)
    delta = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
    return [np.cumsum(x) for x in np.split(delta, np.cumsum(sizes)[:-1])] if len(sizes) else []


def _segments(vocabulary: list[str] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary(vocabulary) if vocabulary is not None else None
        for batch in batches:
            for part in slices(batch, most=SEGMENT_BYTES):
                buf, offsets = joined(part.column("text"))
                start, end = bounds(buf, offsets)
                n_words = word_counts(start, offsets)
                position = np.arange(len(start)) + np.repeat(np.arange(part.num_rows) * GAP, n_words)
                if known is None:
                    h = hashes(buf, start, end)
                    _, first, term = np.unique(h, return_index=True, return_inverse=True)
                    names = [buf[start[i] : end[i]].tobytes().decode() for i in first]
                else:
                    term, names = known.find(buf, start, end), known.terms
                hit = np.flatnonzero(term >= 0)
                term = term[hit]
                order = np.argsort(term.astype(np.uint16) if len(names) < 1 << 16 else term, kind="stable")
                sizes = np.bincount(term, minlength=len(names))
                own = np.flatnonzero(sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                        pa.array([n_words.tolist()], pa.list_(pa.int32())),
                        pa.array([[names[i] for i in own]], pa.list_(pa.string())),
                        pa.array([sizes[own].tolist()], pa.list_(pa.int32())),
                        pa.array([_pack(position[hit][order], sizes[own])], pa.binary()),
                    ],
                    ["doc_ids", "n_words", "terms", "sizes", "postings"],
                )

    return run


def build_index(docs: DataFrame, vocabulary: list[str] | None = None) -> DataFrame:
    """The positional index of ``docs`` (``doc_id``, ``text``): a row for each segment.

    ``vocabulary`` None keeps all terms (told apart by a 64-bit hash); else those terms, compared byte by byte.
    """
    return in_arrow(texts(docs), _segments(vocabulary), INDEX)


class Segment:
    """One segment's lists, ready to be searched."""

    def __init__(self, doc_ids, n_words, terms, sizes, postings):
        self.doc_ids, self.n_words = list(doc_ids), np.asarray(n_words, np.int64)
        self.begin = np.cumsum(self.n_words + GAP) - (self.n_words + GAP)
        self.lists = dict(zip(terms, unpack(postings, np.asarray(sizes)), strict=True))

    def phrase(self, words: list[str]) -> np.ndarray:
        """Positions at which ``words`` begin, exactly in this order."""
        own = [(self.lists.get(w), k) for k, w in enumerate(words)]
        if not own or any(x is None for x, _ in own):
            return np.zeros(0, np.int64)
        own.sort(key=lambda x: len(x[0]))
        at = own[0][0] - own[0][1]
        for positions, k in own[1:]:
            if not len(at):
                break
            i = np.minimum(np.searchsorted(positions, at + k), len(positions) - 1)
            at = at[positions[i] == at + k]
        return at

    def near(self, words: list[str], slop: int) -> np.ndarray:
        """Positions of the rarest of ``words`` with all the others, in any order, at most ``slop`` words away (below the gap)."""
        own = sorted((self.lists.get(w, np.zeros(0, np.int64)) for w in set(words)), key=len)
        if not own or not len(own[0]):
            return np.zeros(0, np.int64)
        at = own[0]
        for positions in own[1:]:
            i = np.searchsorted(positions, at - slop)
            at = at[(i < len(positions)) & (positions[np.minimum(i, len(positions) - 1)] <= at + slop)] if len(positions) else at[:0]
        return at

    def where(self, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The document of each position, and the word in it."""
        doc = np.searchsorted(self.begin, position, side="right") - 1
        return doc, position - self.begin[doc]


def windows_of(words: list[str], window: int = WINDOW) -> list[list[str]]:
    return [words[i : i + window] for i in range(max(1, len(words) - window + 1))] if words else []


def _search(items: list[tuple[str | None, list[str]]], window: int, slop: int | None):
    """For each document of each segment: its windows that match, each as item, first word and number of words."""
    terms = {w: i for i, w in enumerate(dict.fromkeys(w for _, words in items for w in words))}
    wins = [(item, w) for item, words in items for w in windows_of(words, window)]
    longest = max((len(w) for _, w in wins), default=1)
    grid = np.full((len(wins), longest), len(terms), np.int64)
    for i, (_, w) in enumerate(wins):
        grid[i, : len(w)] = [terms[x] for x in w]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                seg = Segment(row.doc_ids, row.n_words, row.terms, row.sizes, row.postings)
                there = np.zeros(len(terms) + 1, bool)
                there[[terms[t] for t in seg.lists if t in terms]] = True
                there[-1] = True
                found: list[list[dict]] = [[] for _ in seg.doc_ids]
                for i in np.flatnonzero(there[grid].all(1)):
                    item, w = wins[i]
                    at = seg.phrase(w) if slop is None else seg.near(w, slop)
                    for d, k in zip(*seg.where(at), strict=True):
                        found[d].append({"item_id": item, "start": int(k), "n_words": len(w) if slop is None else 1})
                yield pd.DataFrame({"segment": row.segment, "place": np.arange(len(found)), "doc_id": pd.array(seg.doc_ids, "Int64"), "n_words": seg.n_words, "matches": found})
            give_back()

    return run


def item_blocks(items: DataFrame, window: int, most: int) -> Iterator[list[tuple[str | None, list[str]]]]:
    """The test items in blocks of at most ``most`` windows (one item at least), streamed to the driver."""
    block, size = [], 0
    for row in items.toLocalIterator():
        words = words_of(row["text"])
        if block and size + len(words) > most:
            yield block
            block, size = [], 0
        if words:
            block.append((row["item_id"], words))
            size += max(1, len(words) - window + 1)
    yield block


def numbered_rows(docs: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """``docs`` written once with a number of each row's own, and that column's name."""
    row = free_name(docs, "row")
    return written(docs.withColumn(row, F.monotonically_increasing_id()), tag), row


def vocabulary_of(items: DataFrame) -> list[str] | None:
    """The distinct words of ``items`` (``text``), sorted; None if there are more than ``VOCABULARY``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(sorted(set(words_of(text))), pa.string())], ["word"])

    words = in_arrow(items.select("text"), run, "word string").distinct().limit(VOCABULARY + 1).collect()
    return sorted(r.word for r in words) if len(words) <= VOCABULARY else None


def search(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int | None = None, block: int = BLOCK_WINDOWS) -> DataFrame:
    """``doc_id, n_words, matches`` for each row of ``docs``: exact phrases, or with ``slop`` windows whose words lie that near.

    ``items`` has ``item_id`` (of any type; given as text), ``text``.  An item is searched as all its windows of ``window`` words, or whole if it
    has fewer.  Null or empty items match nothing, null or empty documents have no words.  Rows that share a ``doc_id``, or have none, are told
    apart; texts of any length are searched whole; other columns are ignored.  No documents: no rows.  No items: no matches.
    """
    if slop is not None and slop >= GAP or window > GAP:
        raise ValueError(f"windows and slop must stay below {GAP} words")
    plain = items.select(items["item_id"].cast("string").alias("item_id"), items["text"].cast("string").alias("text"))
    # A segment's number is written with it, so a row of the table is the same row in every block.
    index = written(build_index(docs, vocabulary_of(plain)).withColumn("segment", F.monotonically_increasing_id()), "index")
    found = [index.mapInPandas(_search(own, window, slop), FOUND) for own in item_blocks(plain, window, block)]
    if len(found) == 1:
        return found[0].select("doc_id", "n_words", "matches")
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more.where(F.size("matches") > 0))
    whole = whole.groupBy("segment", "place").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("matches")).alias("matches"))
    return whole.select("doc_id", "n_words", "matches")


def hit_words(matches: Column) -> Column:
    """How many words of a document its matches cover: the length of the union of their spans."""
    spans = F.array_sort(F.array_distinct(F.transform(matches, lambda m: F.struct(m["start"].cast("long").alias("a"), (m["start"] + m["n_words"]).cast("long").alias("b")))))
    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("upto"))

    def add(acc: Column, s: Column) -> Column:
        more = F.greatest(F.lit(0).cast("long"), s["b"] - F.greatest(s["a"], acc["upto"]))
        return F.struct((acc["total"] + more).alias("total"), F.greatest(acc["upto"], s["b"]).alias("upto"))

    return F.aggregate(spans, zero, add, lambda acc: acc["total"])


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20, block: int = BLOCK_WINDOWS) -> DataFrame:
    """``doc_id, n_words, n_hit, items, contaminated`` for each row of ``docs``.

    Contaminated: at least one word is hit, and at least one in ``share``.  ``items`` are the ids (null ones left out), sorted as
    strings.  A null or empty text has no words and is clean.  Repeats, long texts and other columns as in ``search``.
    """
    found = search(docs, items, window, None, block).withColumn("n_hit", hit_words(F.col("matches")))
    ids = F.array_sort(F.array_distinct(F.filter(F.transform("matches", lambda m: m["item_id"]), lambda i: i.isNotNull())))
    return found.select("doc_id", "n_words", "n_hit", ids.alias("items"), ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20, block: int = BLOCK_WINDOWS) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, each by its own text, also where rows share a ``doc_id`` or have none."""
    rows, row = numbered_rows(docs, "rows")
    own = rows.select(F.col(row).alias("doc_id"), "text")
    return without(rows, contamination(own, items, window, share, block).where("contaminated").select("doc_id"), row).drop(row)
