"""Structured Streaming: a bounded, resumable feed of batches, and event-time windows over events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def file_stream(spark: SparkSession, folder: str, schema: StructType, files: int = 1) -> DataFrame:
    """New Parquet files of a folder, ``files`` to a batch: the producer cannot run ahead of its consumer."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def feed(stream: DataFrame, consume: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Hand every batch to ``consume``; a restart with the same checkpoint resumes after the last one.
    ``once``: all that is there now, then end (validation); otherwise on and on (training) until stop()."""
    writer = stream.writeStream.foreachBatch(consume).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def with_labels(batch: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """A batch joined to the table of labels that producers share."""
    return batch.join(labels, key, "left")


def tumbling_counts(stream: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def deduplicated(stream: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
