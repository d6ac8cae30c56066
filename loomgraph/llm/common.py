"""What the text operators share: the shared folder, written tables, columns and Arrow slices."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a Python worker takes at once; a longer text is a slice of its own.
SLICE_BYTES = 2 << 20
#: Bytes of an Arrow batch on its way to a Python worker; by Spark's own bound (64 MB) JVM and worker would hold several times as much.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or in a local session one of our own where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='loomgraph-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/loomgraph/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again; cuts the lineage and survives lost executors."""
    path = path or new_path(df.sparkSession, tag)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this library has written, wherever Spark keeps it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def in_arrow(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` with batches of ``BATCH_BYTES`` at most, or of one row; the session's setting is lowered for that."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    conf = rows.sparkSession.conf
    if conf.get(name, None) != str(BATCH_BYTES):
        conf.set(name, str(BATCH_BYTES))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return rows.mapInArrow(task, schema)


def long_id(df: DataFrame, name: str = "doc_id") -> Column:
    return df[name].cast("long")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``text`` alone, whatever else the table has; a null text is empty."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def free_name(df: DataFrame, want: str) -> str:
    """``want``, or the first of ``want_1``, ``want_2``... that is no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    name, n = want, 0
    while name.lower() in taken:
        n += 1
        name = f"{want}_{n}"
    return name


def give_back() -> None:
    """Returns memory that a worker has freed to the system; it would else keep its peak for as long as it lives, idle or not."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only
    if trim is not None:
        trim(0)


#: Bytes of text after which a worker gives freed memory back while a task goes on; each time costs some, as memory is asked for anew.
GIVE_BACK_BYTES = 64 << 20
_done = 0


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows with about ``most`` bytes of text each, so that a worker's memory doesn't follow the batch."""
    sizes = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)
    global _done
    _done += int(sizes.sum())
    if _done > GIVE_BACK_BYTES:
        _done = 0
        give_back()


def row_slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Of batches with a struct ``row`` of all columns: slices as above, and their texts, empty where null.  So a text is sent once."""
    row = batch.column("row")
    own = row.field([f.name for f in row.type].index(column)).cast(pa.large_string())
    if own.null_count:
        own = pc.fill_null(own, "")
    whole = pa.RecordBatch.from_arrays([*batch.columns, own], [*batch.schema.names, "own text"])
    for part in slices(whole, "own text", most):
        yield part, part.column("own text")


def text_bytes(column: pa.Array) -> list[bytes]:
    return column.cast(pa.large_binary()).to_pylist()


#: Ids of 8 bytes each that are sent to every executor at once; above it, both sides are dealt by id.
BROADCAST_IDS = 1_000_000


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id isn't in ``ids`` (its only column); null is an id like any other.

    ``ids`` is written once and counted: up to ``BROADCAST_IDS`` it is broadcast and the texts stay where they are.  Above that
    both sides are dealt by id and the ids hashed, so that texts are shuffled but not sorted.
    """
    of = free_name(docs, "dropped_id")
    gone = written(ids.toDF(of).distinct(), "dropped")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone.hint("shuffle_hash")
    return docs.join(gone, docs[id_col].cast("long").eqNullSafe(gone[of]), "left_anti")
