"""Token ids in binary files of patched frame-of-reference blocks.

Documents are dealt by ranges of their id and written in ascending order, each task its own files, so the files in order of name
are the corpus.  A file is

    header      magic, number of documents, of ids, of ids in a block, of blocks, of exceptions
    documents   id and validity of each, its number of ids
    blocks      each block's minimum, width, number of exceptions, and where its words begin
    words       differences to the minimum, packed at the width that ``PERCENTILE`` percent of the block's ids fit in
    exceptions  place in the block and upper bits of the ids that don't fit

Little-endian throughout.  As the index tells where a block begins, any range of ids is read without the rest.
A file is written under a name of its attempt and then renamed: a task that runs twice leaves one whole file.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .chunks import Chunks
from .common import in_arrow, new_path, slices, texts, written
from .token_counts import byte_names

MAGIC = b"LPFR0001"
BLOCK = 1024
LANES = 32
PERCENTILE = 90
#: Ids after which a file ends, and rows that a task is dealt on average.
FILE_IDS = 4_000_000
TASK_ROWS = 5000
#: Distinct chunks that a worker remembers.
CHUNKS = 600_000
END = 1


def _widths(x: np.ndarray) -> np.ndarray:
    """Bits that each number needs."""
    return np.frexp(x.astype(np.float64))[1]


def _lanes(width: int) -> Iterator[tuple[int, int, int]]:
    """Of each group of ``LANES`` numbers: its number, first word, and shift within it."""
    for k in range(BLOCK // LANES):
        yield k, k * width // 32, k * width % 32


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """Blocks (rows) of numbers below 2**width as 32-bit words; number k of a lane lies k widths into the lane's words."""
    n = len(values)
    v = values.reshape(n, BLOCK // LANES, LANES).astype(np.uint32)
    out = np.zeros((n, width + 1, LANES), np.uint32)
    for k, word, shift in _lanes(width):
        out[:, word] |= v[:, k] << np.uint32(shift)
        if shift + width > 32:
            out[:, word + 1] |= v[:, k] >> np.uint32(32 - shift)
    return out[:, :width].reshape(n, -1)


def _unpacked(words: np.ndarray, width: int) -> np.ndarray:
    n = len(words)
    w = words.reshape(n, width, LANES)
    out = np.zeros((n, BLOCK // LANES, LANES), np.uint32)
    mask = np.uint32((1 << width) - 1)
    for k, word, shift in _lanes(width):
        x = w[:, word] >> np.uint32(shift)
        if shift + width > 32:
            x = x | w[:, word + 1] << np.uint32(32 - shift)
        out[:, k] = x & mask
    return out.reshape(n, BLOCK)


def encode_file(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """One file's bytes.  ``ids``: all ids of its documents, below 2**32; ``sizes``: how many each document has."""
    n_blocks = -(-len(ids) // BLOCK)
    grid = np.zeros(n_blocks * BLOCK, np.int64)
    grid[: len(ids)] = ids
    if len(ids):
        grid[len(ids) :] = ids[-1]
    grid = grid.reshape(n_blocks, BLOCK)
    low = grid.min(1) if n_blocks else np.zeros(0, np.int64)
    delta = grid - low[:, None]
    need = _widths(delta)
    width = np.partition(need, BLOCK * PERCENTILE // 100 - 1, axis=1)[:, BLOCK * PERCENTILE // 100 - 1].astype(np.int64) if n_blocks else low
    words = np.zeros(int((width * LANES).sum()), np.uint32)
    begin = np.cumsum(width * LANES) - width * LANES
    for w in np.unique(width[width > 0]):
        own = np.flatnonzero(width == w)
        words[begin[own][:, None] + np.arange(w * LANES)] = _packed(delta[own] & ((1 << int(w)) - 1), int(w))
    block, place = np.nonzero(need > width[:, None])
    upper = delta[block, place] >> width[block]
    valid = np.array([d is not None for d in doc_ids], np.uint8)
    return b"".join(
        [
            MAGIC,
            struct.pack("<QQIQQ", len(doc_ids), len(ids), BLOCK, n_blocks, len(block)),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            valid.tobytes(),
            np.asarray(sizes, "<u4").tobytes(),
            low.astype("<u4").tobytes(),
            width.astype(np.uint8).tobytes(),
            np.bincount(block, minlength=n_blocks).astype("<u2").tobytes(),
            begin.astype("<u8").tobytes(),
            words.astype("<u4").tobytes(),
            place.astype("<u2").tobytes(),
            upper.astype("<u4").tobytes(),
        ]
    )


class TokenFile:
    """A file's bytes, read block by block as asked for."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("not a token file")
        n_docs, self.n_ids, block, n_blocks, n_odd = struct.unpack_from("<QQIQQ", raw, 8)
        if block != BLOCK:
            raise ValueError("another block size")
        at = 8 + struct.calcsize("<QQIQQ")

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out

        ids, valid = take("<i8", n_docs), take("u1", n_docs)
        self.doc_ids = [int(d) if v else None for d, v in zip(ids, valid, strict=True)]
        self.sizes = take("<u4", n_docs).astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.low, self.width, odd = take("<u4", n_blocks), take("u1", n_blocks).astype(np.int64), take("<u2", n_blocks).astype(np.int64)
        self.begin = take("<u8", n_blocks).astype(np.int64)
        self.words = take("<u4", int((self.width * LANES).sum()))
        self.place, self.upper = take("<u2", n_odd).astype(np.int64), take("<u4", n_odd)
        self.odd = np.concatenate([[0], np.cumsum(odd)])

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids from ``start`` to before ``stop``, counted through the file."""
        stop = self.n_ids if stop is None else min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK, -(-stop // BLOCK)
        width = self.width[first:last]
        out = np.zeros((last - first, BLOCK), np.uint32)
        for w in np.unique(width[width > 0]):
            own = np.flatnonzero(width == w)
            out[own] = _unpacked(self.words[self.begin[first + own][:, None] + np.arange(w * LANES)], int(w))
        a, b = self.odd[first], self.odd[last]
        block = np.repeat(np.arange(last - first), np.diff(self.odd[first : last + 1]))
        out[block, self.place[a:b]] |= self.upper[a:b] << width[block].astype(np.uint32)
        out += self.low[first:last, None]
        return out.ravel()[start - first * BLOCK : stop - first * BLOCK]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k] + self.sizes[k]))


#: Letters above ASCII that are composed already and have one lower case, as the byte-level alphabet writes their UTF-8 bytes.
_LETTERS = {b: c for c, b in byte_names().items()}
_BYTES = {k: "".join(_LETTERS[b] for b in chr(k).encode()) for k in range(128, 256) if chr(k).isalpha()}


class Tokenizer:
    """Whole texts through a tokenizers file whose pieces of text never span white space, each such piece encoded once.

    Words of Latin-1 letters, with or without one full stop or comma, go straight to the file's model, lower-cased and in byte letters,
    as its normaliser and its splitting would do; all else takes the library's whole way.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer as Library

        self.library = Library.from_str(spec)
        self.stops = {c: [t.id for t in self.library.model.tokenize(c)] for c in ".,"}
        self.chunks = Chunks(self._ids, CHUNKS)

    def _ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        model, out, rest, known = self.library.model.tokenize, [], [], {}
        for i, x in enumerate(chunks):
            stop = x[-1]
            word = x[:-1] if stop in self.stops else x
            if word.isalpha() and (word.isascii() or max(word) <= "\xff"):
                word = word.lower()
                if (own := known.get(word)) is None:
                    own = known[word] = [t.id for t in model(word if word.isascii() else word.translate(_BYTES))]
                out.append(own + self.stops[stop] if stop in self.stops else own)
            else:
                out.append(None)
                rest.append(i)
        for i, e in zip(rest, self.library.encode_batch_fast([chunks[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        sizes = np.fromiter(map(len, out), np.int64, len(out))
        return np.fromiter(chain.from_iterable(out), np.int32, int(sizes.sum())), sizes

    def encode_all(self, texts_: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # Python splits at more than ASCII white space; all of it is white space for the tokenizer, too, or it is cut by hand.
        return self.chunks.ids([_pieces(x) for x in texts_])


#: Characters that str.split() takes for white space but the tokenizer's \s doesn't.
_NOT_SPACE = "\x1c\x1d\x1e\x1f"


def _lower(text: str) -> str:
    """The text in lower case where Python's is surely the tokenizer's, so that a word is one chunk however it is written; else as it is."""
    if text.isascii():
        return text.lower()
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


def _pieces(text: str) -> list[str]:
    text = _lower(text)
    if text.isascii() and not any(c in text for c in _NOT_SPACE):
        return text.split()
    return [x for x in text.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if x]


_tokenizers: dict[int, Tokenizer] = {}


def _tokenizer(spec: str) -> Tokenizer:
    key = zlib.crc32(spec.encode())
    if key not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[key] = Tokenizer(spec)
    return _tokenizers[key]


MANIFEST = "task int, part int, file string, n_docs long, n_ids long"


def _write(path: str, spec: str, end: int | None, file_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(spec)
        where, folder = fs.FileSystem.from_uri(path)
        context = TaskContext.get()
        task, attempt, part = context.partitionId(), context.taskAttemptId(), 0
        docs, sizes, held, n = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal part, docs, sizes, held, n
            name = f"part-{task:07d}-{part:05d}.ids"
            with where.open_output_stream(f"{folder}/.{name}.{attempt}") as f:
                f.write(encode_file(docs, np.concatenate(sizes), np.concatenate(held)))
            where.move(f"{folder}/.{name}.{attempt}", f"{folder}/{name}")
            row = pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((task, pa.int32()), (part, pa.int32()), (name, pa.string()), (len(docs), pa.int64()), (n, pa.int64()))], ["task", "part", "file", "n_docs", "n_ids"])
            part, docs, sizes, held, n = part + 1, [], [], [], 0
            return row

        for batch in batches:
            for own in slices(batch):
                ids, at = tokenizer.encode_all(own.column("text").to_pylist())
                size = np.diff(at)
                if end is not None:
                    ids, size = np.insert(ids, at[1:], end), size + 1
                docs += own.column("doc_id").to_pylist()
                sizes.append(size)
                held.append(ids)
                n += len(ids)
                if n >= file_ids:
                    yield flush()
        if docs:
            yield flush()

    return run


def write_token_files(docs: DataFrame, spec: str, path: str | None = None, end: int | None = END, task_rows: int = TASK_ROWS, file_ids: int = FILE_IDS) -> tuple[str, DataFrame]:
    """Writes the ids of ``docs`` to files; returns their folder and the manifest (``task, part, file, n_docs, n_ids``).

    ``spec`` is the text of a tokenizers file, ``end`` the id that closes each document (None: none).  Order: ascending ``doc_id``,
    null first, rows of the same id by a hash of their text.  Null and empty texts have the end id only.
    """
    spark = docs.sparkSession
    path = path or f"{new_path(spark, 'tokens')}/files"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(where)
    parts = max(1, -(-docs.count() // task_rows))
    dealt = texts(docs).withColumn("tie", F.xxhash64("text")).repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    manifest = written(in_arrow(dealt, _write(path, spec, end, file_ids), MANIFEST), "manifest", f"{path}-manifest")
    return path, manifest


def starts(manifest: DataFrame) -> DataFrame:
    """``file, base``: how many ids all files before it have.  In two levels, so that no task sorts all files."""
    files = manifest.withColumn("group", F.floor(F.col("task") / 1000))
    before = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = files.groupBy("group").agg(F.sum("n_ids").alias("n")).select("group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("of_groups"))
    within = Window.partitionBy("group").orderBy("task", "part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("of_files", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).join(groups, "group").select("file", (F.col("of_groups") + F.col("of_files")).alias("base"))


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for path, content in zip(frame["path"], frame["content"], strict=True):
            file = TokenFile(bytes(content))
            blob = file.ids().astype("<u4").tobytes()
            crc = [zlib.crc32(blob[4 * a : 4 * (a + n)]) for a, n in zip(file.starts.tolist(), file.sizes.tolist(), strict=True)]
            yield pd.DataFrame({"doc_id": pd.array(file.doc_ids, "Int64"), "file": path.rsplit("/", 1)[-1], "local": file.starts, "n_tokens": file.sizes, "ids_crc32": crc})


def _files(spark, path: str) -> DataFrame:
    kind = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])
    return spark.read.format("binaryFile").schema(kind).option("pathGlobFilter", "part-*.ids").load(path).select("path", "content")


def token_digests(spark, path: str, manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, from the files.

    A row for each row that was written, repeats and null ids included; an empty text has what ``end`` gives it.  No documents: no files, no rows.
    """
    rows = _files(spark, path).mapInPandas(_read, "doc_id long, file string, local long, n_tokens long, ids_crc32 long")
    return rows.join(starts(manifest), "file").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def read_token_files(spark, path: str) -> DataFrame:
    """``doc_id, file, position, ids`` of each document, from the files; rows as in ``token_digests``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                file = TokenFile(bytes(content))
                for k in range(0, len(file.doc_ids), 500):
                    own = range(k, min(k + 500, len(file.doc_ids)))
                    yield pd.DataFrame({"doc_id": pd.array([file.doc_ids[i] for i in own], "Int64"), "file": name.rsplit("/", 1)[-1], "position": list(own), "ids": [file.document(i).astype(np.int64) for i in own]})

    return _files(spark, path).mapInPandas(run, "doc_id long, file string, position long, ids array<long>")
