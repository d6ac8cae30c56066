"""Tables written in the folder that driver and executors share, to cut lineage in loops and mutations."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or a folder of our own where it is unset, as in a local session."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='loomgraph-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def session_dir(spark: SparkSession) -> str:
    """The folder of all that this library writes in a session, within the shared folder."""
    return f"{shared_dir(spark)}/loomgraph/{spark.sparkContext.applicationId}"


def written_path(spark: SparkSession, tag: str) -> str:
    """A new folder's path in the shared folder."""
    return f"{session_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


class Rounds:
    """One table a round; a round's table goes once the one after the next is written."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.path, self.n = spark, written_path(spark, tag), 0

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` as a table; it may read the round before, which therefore stays until the next call."""
        path = f"{self.path}/{self.n}"
        df.write.parquet(path)
        if self.n > 1:
            self._drop(self.n - 2)
        self.n += 1
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Removes what is left, when nobody reads it any more."""
        for n in range(max(0, self.n - 2), self.n):
            self._drop(n)

    def _drop(self, n: int) -> None:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}")
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clear(spark: SparkSession) -> None:
    """Removes all intermediate tables of the session, once its results are saved: frames that read them are of no use any more."""
    from .queries import _graphs
    from .sources.star import _numbered

    _graphs.clear()
    _numbered.clear()
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(session_dir(spark))
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, tag: str) -> DataFrame:
    return Rounds(df.sparkSession, tag).keep(df)
