"""Line dedup over levelled sorted runs of line hashes.

``LineRuns`` keeps what has been seen: tables of (line hash, documents that hold it, largest document id), each sorted by
hash.  ``add`` merge-anti-joins a batch against the runs: the hashes that no run has are a new run of level 0, so that a hash is in one run only,
and those seen before go to tables of further counts.  ``FANOUT`` runs of a level are merged into one of the next, so that a batch meets few runs
and a hash is rewritten once a level.

``dedup_lines`` needs counts over the whole corpus, thus it adds all batches and then merge-joins the lines of the documents against the keys to be
dropped.  Texts are read twice and shuffled once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, in_arrow, new_path, remove, row_slices, slices, text_bytes, written

SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
FANOUT = 4
BATCHES = 4


def line_keys(lines: list[bytes], least: int) -> list[bytes | None]:
    """16 bytes for each line whose key has ``least`` code points or more; else None."""
    out = []
    for line in lines:
        key = line.strip(SPACE).lower()  # bytes.lower() changes A-Z only
        if len(key) < least or not key.isascii() and len(key.decode("utf-8", "replace")) < least:
            out.append(None)
        else:
            out.append(xxhash.xxh3_128_digest(key))
    return out


def _keys_of(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                ids, keys = [], []
                for doc, text in zip(part.column("doc_id").to_pylist(), text_bytes(part.column("text")), strict=True):
                    own = {k for k in line_keys(text.split(b"\n"), least) if k}
                    keys += own
                    ids += [doc] * len(own)
                words = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words[:, 0]), pa.array(words[:, 1])], ["doc_id", "h1", "h2"])

    return run


def doc_lines(docs: DataFrame, least: int = 20) -> DataFrame:
    """``doc_id, h1, h2``: each document's distinct line hashes (128 bits in two columns)."""
    return in_arrow(docs, _keys_of(least), "doc_id long, h1 long, h2 long")


SEEN = "h1 long, h2 long, n_docs long, max_doc long"


class LineRuns:
    """Levelled sorted runs in the shared folder (or under ``path``).

    An empty batch adds no hash.  A document's id may be null; it counts as a document and is smaller than any other.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = FANOUT):
        self.spark, self.path, self.fanout, self.made = spark, path or new_path(spark, "line-runs"), fanout, 0
        self.levels: list[list[str]] = []
        self.again: list[str] = []
        self.merged: list[str] = []

    def _new(self, name: str) -> str:
        self.made += 1
        return f"{self.path}/{name}-{self.made}"

    def _write(self, df: DataFrame, level: int) -> None:
        path = self._new(f"level-{level}-run")
        # The join or aggregation has already dealt the rows by hash: the sort is within its partitions, without another shuffle.
        df.sortWithinPartitions("h1", "h2").write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(SEEN).parquet(*paths) if paths else self.spark.createDataFrame([], SEEN)

    @property
    def runs(self) -> list[str]:
        return [p for own in self.levels for p in own]

    @staticmethod
    def _merged(rows: DataFrame) -> DataFrame:
        return rows.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"))

    def _replace(self, runs: list[str], df: DataFrame, level: int) -> None:
        self._write(df, level)
        for own in self.levels:
            own[:] = [p for p in own if p not in runs]
        self.merged += runs

    def compact(self, whole: bool = False) -> None:
        """Merges each level that has ``fanout`` runs into the next; ``whole`` merges all runs and further counts into one run."""
        if whole:
            again, self.again = self.again, []
            self._replace([*self.runs, *again], self._merged(self._read([*self.runs, *again])), len(self.levels))
            return
        level = 0
        while level < len(self.levels):
            if len(runs := list(self.levels[level])) >= self.fanout:
                self._replace(runs, self._merged(self._read(runs)), level + 1)
            level += 1

    def seen(self) -> DataFrame:
        """All that has been added as one relation, one row a hash."""
        return self._merged(self._read([*self.runs, *self.again]))

    def add(self, lines: DataFrame) -> DataFrame:
        """Adds a batch of ``doc_lines``; returns its hashes that no earlier batch had, to be read before the next batch is added."""
        for path in self.merged:
            remove(self.spark, path)
        self.merged = []
        own = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("max_doc"))
        if not self.runs:
            self._write(own, 0)
            return self._read(self.levels[0][-1:])
        own = written(own, "line-batch")
        known = self._read(self.runs).select("h1", "h2").hint("merge")
        self._write(own.join(known, ["h1", "h2"], "left_anti"), 0)
        fresh = self._read(self.levels[0][-1:])
        again = self._new("again")
        own.join(known, ["h1", "h2"], "left_semi").select("h1", "h2", "n_docs", "max_doc").write.parquet(again)
        self.again.append(again)
        self.compact()
        return fresh


def _drop_from(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, own_text in row_slices(batch):
                rows, kept, n_lines, n_dropped = part.column("row"), [], [], []
                drops = part.column("drops")
                at = drops.offsets.to_numpy()
                pairs = drops.values.flatten() if len(drops.values) else [pa.array([], pa.int64())] * 2
                blob = np.stack([pairs[0].to_numpy(), pairs[1].to_numpy()], 1).astype("<i8").tobytes()
                valid = drops.is_valid().to_pylist()
                for i, text in enumerate(text_bytes(own_text)):
                    lines = text.split(b"\n")
                    n_lines.append(len(lines))
                    if valid[i] and at[i] < at[i + 1]:
                        gone = {blob[16 * j : 16 * j + 16] for j in range(at[i], at[i + 1])}
                        lines = [x for x, k in zip(lines, line_keys(lines, least), strict=True) if k not in gone]
                        text = b"\n".join(lines)
                    kept.append(text)
                    n_dropped.append(n_lines[-1] - len(lines))
                yield pa.RecordBatch.from_arrays([rows, pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], ["row", "kept", "n_lines", "n_dropped"])

    return run


def dedup_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, batches: int = BATCHES) -> DataFrame:
    """``docs`` with ``text`` rid of repeated lines, plus ``n_lines`` and ``n_dropped`` (suffixed if ``docs`` has such names).

    A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased.  Keys of ``least_chars`` code points or
    more that ``least_docs`` rows hold lose their lines except in the row of the largest ``doc_id``.  Null texts are empty, one
    empty line.  A null ``doc_id`` counts as the smallest.  Rows that repeat a ``doc_id`` count one by one and lose or keep a
    line together.  Texts and lines of any length are read whole.  An empty table gives an empty table.
    """
    spark = docs.sparkSession
    body = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    path = new_path(spark, "lines")
    doc_lines(body.select("doc_id", "text"), least_chars).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")).write.partitionBy("batch").parquet(path)
    lines = spark.read.schema("doc_id long, h1 long, h2 long, batch int").parquet(path)
    runs = LineRuns(spark)
    for b in range(batches):
        runs.add(lines.where(F.col("batch") == b))
    # Written first: both sides of the join are then dealt as they are read, which is what AQE can split.
    often = written(runs.seen().where(F.col("n_docs") >= least_docs).select("h1", "h2", "max_doc"), "often")
    # Sorted runs against sorted lines; a line that a third of all documents share is a skewed join key, which AQE splits.
    gone = lines.join(often.hint("merge"), ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("max_doc")))
    drops = gone.groupBy("doc_id").agg(F.collect_list(F.struct("h1", "h2")).alias("drops"))
    # The lists are small beside the texts: they are hashed, so the texts stream through unsorted.
    both = body.join(drops.withColumnRenamed("doc_id", "of").hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("of")), "left").select("row", "drops")
    result = T.StructType([T.StructField("row", body.schema["row"].dataType), T.StructField("kept", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    done = in_arrow(both, _drop_from(least_chars), result)
    n_lines, n_dropped = free_name(docs, "n_lines"), free_name(docs, "n_dropped")
    return done.select(*[(F.col("kept") if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns], F.col("n_lines").alias(n_lines), F.col("n_dropped").alias(n_dropped))
