"""Keeping an index current: new files by a file stream, removed ones by comparing listings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from foliant.operators.changes import change_set, content_key


def watch(spark: SparkSession, folder: str, schema: str, checkpoint: str, index: Callable[[DataFrame, int], None], source: str = "parquet", once: bool = False) -> StreamingQuery:
    """Feed documents that appear in ``folder`` to ``index(batch, number)``.

    Within a batch the last of a name stays; batches may be repeated after a failure, so ``index``
    must be an upsert. ``once``: take what is there and end.
    """

    def each(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy("name").agg(F.max_by(F.struct(*batch.columns), F.struct("mtime", "text")).alias("x")).select("x.*")
        index(latest.withColumn("content_hash", content_key("text")), number)

    stream = spark.readStream.schema(schema).format(source).load(folder)
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()


def removed(known: DataFrame, listing: DataFrame) -> DataFrame:
    """``path`` of known files that a listing no longer has: a file stream cannot tell."""
    return change_set(known, listing).where("change = 'removed'").select("path")


def log_counts(events: DataFrame, every: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Records, failures and time of a stream of log records by window; late ones up to ``late``."""
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
    )
