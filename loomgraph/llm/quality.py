"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Each text becomes a sparse vector: its words hashed into ``BUCKETS`` (counts scaled to unit length) and some dense statistics of
the whole text, among them ``n_chars`` as its metadata.  The machine's pairwise term uses the sum-of-squares identity

    sum over i < j of <v_i, v_j> x_i x_j  =  1/2 * sum over f of [(sum over i of v_if x_i)^2 - sum over i of v_if^2 x_i^2],

so that a score takes time linear in the words.  ``lang``, ``source``, ``doc_id`` and labels are no features.
The machine is trained on the driver from at most ``max_rows`` labelled rows; scoring is a pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, in_arrow, row_slices, slices
from .words import bounds, hashes, joined, word_counts

BUCKETS = 1 << 16
RANK = 8
#: The labelled rows that are taken at most, smallest hash of the id first; what the driver gathers is bounded by it.
MAX_ROWS = 8000
THRESHOLD = 0.3
FOLDS = 5

#: Not white space as [^\x20\x09-\x0D] says.
IS_TOKEN = np.ones(256, bool)
IS_TOKEN[[9, 10, 11, 12, 13, 32]] = False
KINDS = ("upper", "lower", "digit", "space", "newline", "high", "bar", "mark", "stop", "bracket", "other")


def _kinds() -> np.ndarray:
    kind = np.full(256, KINDS.index("other"), np.uint8)
    for name, chars in (("upper", range(65, 91)), ("lower", range(97, 123)), ("digit", range(48, 58)), ("space", b" \t\r\x0b\x0c"), ("newline", b"\n"), ("high", range(128, 256)), ("bar", b"|"), ("mark", b"*#$&%!@^~=+_"), ("stop", b".,;:?'\"-"), ("bracket", b"()[]{}<>/\\")):
        kind[list(chars)] = KINDS.index(name)
    return kind


KIND = _kinds()
STATS = [*KINDS, "log_bytes", "log_words", "word_length", "line_words", "distinct", "top_share", "marked_words", "no_letters", "log_n_chars", "has_n_chars"]


def _share(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    return x / np.maximum(of, 1)


def features(column: pa.Array, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: offsets into buckets and values of its words, and its dense statistics.  ``n_chars``: NaN where unknown."""
    raw = column.cast(pa.large_string()).cast(pa.large_binary())
    buf, offsets = joined(raw)
    first = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset]
    whole = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[first : first + len(buf)]
    n, size = len(column), np.diff(offsets)
    kind = KIND[whole]
    sums = np.zeros((len(buf) + 1,), np.int64)
    shares = []
    for k in range(len(KINDS)):
        np.cumsum(kind == k, out=sums[1:])
        shares.append(sums[offsets[1:]] - sums[offsets[:-1]])
    newlines = shares[KINDS.index("newline")]
    np.cumsum((kind == KINDS.index("upper")) | (kind == KINDS.index("lower")) | (kind == KINDS.index("high")), out=sums[1:])

    start, end = bounds(buf, offsets, IS_TOKEN)
    n_words = word_counts(start, offsets)
    doc = np.repeat(np.arange(n), n_words)
    letters = sums[end] - sums[start]
    last = kind[end - 1] if len(end) else np.zeros(0, np.uint8)
    marked = (last == KINDS.index("mark")) | (last == KINDS.index("bar"))
    bucket = (hashes(buf, start, end) >> np.uint64(48)).astype(np.int64)
    key, count = np.unique(doc * BUCKETS + bucket, return_counts=True)
    of, index = key // BUCKETS, key % BUCKETS
    at = np.searchsorted(of, np.arange(n + 1))
    norm = np.sqrt(np.bincount(of, count.astype(float) ** 2, n))
    top = np.zeros(n)
    np.maximum.at(top, of, count)
    by_doc = lambda x: np.bincount(doc, x, n)
    known = ~np.isnan(n_chars)
    stats = [*(_share(x, size) for x in shares), np.log1p(size), np.log1p(n_words), _share(by_doc((end - start).astype(float)), n_words), np.log1p(n_words / (newlines + 1)), _share(np.diff(at), n_words), _share(top, n_words), _share(by_doc(marked.astype(float)), n_words), _share(by_doc((letters == 0).astype(float)), n_words), np.log1p(np.where(known, np.maximum(n_chars, 0), 0)), known.astype(float)]
    return at, index, (count / norm[of]).astype(np.float32), np.stack(stats, 1).astype(np.float32)


class Machine:
    """w0, w and v of a factorisation machine; dense statistics come after the buckets, standardised as in training."""

    def __init__(self, rank: int = RANK, seed: int = 7):
        r = np.random.default_rng(seed)
        size = BUCKETS + len(STATS)
        self.w0, self.w, self.v = 0.0, np.zeros(size, np.float32), r.normal(0, 0.01, (size, rank)).astype(np.float32)
        self.mean, self.scale, self.seed = np.zeros(len(STATS), np.float32), np.ones(len(STATS), np.float32), seed

    def _rows(self, at, index, value, stats):
        """Words and statistics of each row as one sparse matrix."""
        dense = np.clip((stats - self.mean) / self.scale, -5, 5) / np.sqrt(len(STATS))
        n, words = len(stats), np.diff(at)
        starts = np.concatenate([[0], np.cumsum(words + len(STATS))])
        i, x = np.empty(starts[-1], np.int64), np.empty(starts[-1], np.float32)
        own = (starts[:-1, None] + np.arange(len(STATS))).ravel()
        rest = np.ones(starts[-1], bool)
        rest[own] = False
        i[own], x[own] = np.tile(BUCKETS + np.arange(len(STATS)), n), dense.ravel()
        i[rest], x[rest] = index, value
        return starts, i, x

    def _raw(self, starts, i, x):
        vx = self.v[i] * x[:, None]
        total = np.add.reduceat(vx, starts[:-1], axis=0)
        squares = np.add.reduceat((vx * vx).sum(1), starts[:-1])
        return self.w0 + np.add.reduceat(self.w[i] * x, starts[:-1]) + 0.5 * ((total * total).sum(1) - squares), vx, total

    def scores(self, at, index, value, stats) -> np.ndarray:
        if not len(stats):
            return np.zeros(0)
        raw, _, _ = self._raw(*self._rows(at, index, value, stats))
        return 1 / (1 + np.exp(-np.clip(raw.astype(float), -30, 30)))

    def fit(self, at, index, value, stats, label: np.ndarray, steps: int = 2500, batch: int = 64, rate: float = 0.1, decay: float = 1e-4) -> Machine:
        """Logistic loss, AdaGrad.  One class only, or no rows: a constant score, the smoothed share of label 1."""
        n, ones = len(label), int(label.sum())
        self.w0 = float(np.log((ones + 1) / (n - ones + 1)))
        if not 0 < ones < n:
            self.v[:] = 0
            return self
        self.mean, self.scale = stats.mean(0), stats.std(0) + 1e-3
        starts, i, x = self._rows(at, index, value, stats)
        sum0, sum_w, sum_v = 1e-2, np.full(self.w.shape, 1e-2, np.float32), np.full(self.v.shape, 1e-2, np.float32)
        order = np.random.default_rng(self.seed)
        for _ in range(-(-steps * batch // n)):
            deal = order.permutation(n)
            for b in range(0, n, batch):
                rows = deal[b : b + batch]
                size = np.diff(starts)[rows]
                own = np.concatenate([[0], np.cumsum(size)])
                pick = np.repeat(starts[rows] - own[:-1], size) + np.arange(own[-1])
                ib, xb = i[pick], x[pick]
                raw, vx, total = self._raw(own, ib, xb)
                g = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - label[rows]) / len(rows)
                gx = np.repeat(g, size) * xb
                uniq, back = np.unique(ib, return_inverse=True)
                gw = np.bincount(back, gx, len(uniq)) + decay * self.w[uniq] / n
                part = gx[:, None] * (np.repeat(total, size, axis=0) - vx)
                gv = np.stack([np.bincount(back, part[:, f], len(uniq)) for f in range(part.shape[1])], 1) + decay * self.v[uniq]
                sum_w[uniq] += gw**2
                sum_v[uniq] += gv**2
                sum0 += g.sum() ** 2
                self.w[uniq] -= rate * gw / np.sqrt(sum_w[uniq])
                self.v[uniq] -= rate * gv / np.sqrt(sum_v[uniq])
                self.w0 -= rate * g.sum() / np.sqrt(sum0)
        return self


def held_out(doc_id: Column) -> Column:
    """The fold that no label is learnt from: crc32 of the id as text divides by ``FOLDS``.  A null id isn't in it."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def _plain(docs: DataFrame) -> DataFrame:
    n_chars = docs["n_chars"].cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"), n_chars.alias("n_chars"))


def _nan(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(float)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> Machine:
    """A machine fitted to rows of ``labels`` outside the held-out fold.

    A document with several labels has the largest; null ids and null labels are left out.  Of labelled documents with the
    same id one row counts, by a hash of its text.  At most ``max_rows`` labelled documents are taken, by a hash of their ids.
    """
    rows = labels.select(labels["doc_id"].cast("long").alias("id"), labels[label].cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)")
    rows = rows.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    # At most max_rows of 12 bytes: a bounded side.
    rows = rows.orderBy(F.xxhash64("id"), "id").limit(max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                at, index, value, stats = features(part.column("text"), _nan(part.column("n_chars")))
                cut = lambda x: [x[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array(cut(index.astype(np.uint16)), pa.binary()), pa.array(cut(value), pa.binary()), pa.array([x.tobytes() for x in stats], pa.binary())], ["id", "y", "i", "x", "s"])

    own = _plain(docs).join(F.broadcast(rows), F.col("doc_id") == F.col("id")).select("doc_id", "text", "n_chars", "y")
    one = own.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text", "n_chars", "y")).alias("r")).select("doc_id", "r.text", "r.n_chars", "r.y")
    got = sorted(in_arrow(one, run, "id long, y int, i binary, x binary, s binary").collect())
    index = [np.frombuffer(r.i, np.uint16) for r in got]
    at = np.concatenate([[0], np.cumsum([len(x) for x in index])]).astype(np.int64)
    stats = np.frombuffer(b"".join(r.s for r in got), np.float32).reshape(-1, len(STATS))
    value = np.frombuffer(b"".join(r.x for r in got), np.float32)
    return Machine().fit(at, np.concatenate([np.zeros(0, np.uint16), *index]).astype(np.int64), value, stats, np.array([r.y for r in got], float))


def _score(machine: Machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, text in row_slices(batch):
                score = machine.scores(*features(text, _nan(part.column("n_chars"))))
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(score, pa.float64())], ["row", "score"])

    return run


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """``docs`` with ``score`` from 0 to 1 (suffixed if there is such a column); higher: label 1 is likelier.

    Null texts are empty; empty texts have a score too.  ``n_chars`` may be missing or null.
    """
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), (docs["n_chars"].cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")).alias("n_chars"))
    out = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("score", T.DoubleType())])
    name = free_name(docs, "score")
    return in_arrow(rows, _score(machine), out).select("row.*", F.col("score").alias(name))


def kept(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more."""
    done = scored(docs, machine)
    return done.where(F.col(done.columns[-1]) >= threshold).select(*docs.columns)
