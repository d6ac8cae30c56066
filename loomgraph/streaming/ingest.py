"""Edges that arrive as a stream, and degrees kept up with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def append_edges(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes a stream of ``src, dst, label`` to Parquet edge files, each micro-batch once; ids number a batch's edges above all earlier batches'.

    A batch's number takes the high bits of an id (2**19 batches; one more fails).  A batch that runs again after a failure replaces its own folder.
    """

    def put(batch: DataFrame, number: int) -> None:
        if number >= 1 << 19:
            raise OverflowError(f"batch {number} has no ids left")
        # Within a batch: the partition's number (11 bits, thus so many partitions at most) and the row's place in it (33 bits), unique without a sort.
        rows = batch.coalesce(1 << 11).withColumn("id", F.lit(number << 44) + F.monotonically_increasing_id())
        rows.select("id", "src", "dst", "label").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_degrees(stream: DataFrame, direction: str = "out") -> DataFrame:
    """``id, degree`` of a stream of edges, for output mode update or complete."""
    return stream.groupBy(F.col("src" if direction == "out" else "dst").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


def windowed_edges(stream: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """``start, label, n``: edges of each label in each window of event time; rows later than ``late`` behind the newest are dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), "label").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "label", "n")
