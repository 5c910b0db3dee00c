"""Incremental indexing as a stream, and windows over an event stream with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodegraph.sources.ingest import extract_symbols


def index_stream(spark: SparkSession, inbox: str, store: str, checkpoint: str) -> StreamingQuery:
    """Parse each new batch of source files (path, content, seq) and append its symbols, a folder a batch.

    A batch that is written again after a failure overwrites its own folder, so every file
    counts once; readers take the row of highest ``seq`` per id.
    """
    def write(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("path").agg(F.max_by("content", "seq").alias("content"))
        extract_symbols(last).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{store}/batch={number}")

    files = spark.readStream.schema("path string, content string, seq long").parquet(inbox)
    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(events: DataFrame, size: str = "1 day", late: str | None = None) -> DataFrame:
    """(start, event_type, n, total) per window; in a stream, ``late`` bounds how late data may come."""
    e = events.withWatermark("ts", late) if late and events.isStreaming else events
    return e.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "2 days", step: str = "1 day", late: str | None = None) -> DataFrame:
    e = events.withWatermark("ts", late) if late and events.isStreaming else events
    return e.groupBy(F.window("ts", size, step).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("user_id").alias("users")).select(F.col("w.start").alias("start"), "n", "users")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """(user_id, start, end, n): runs of a user's events with no pause of ``gap`` or more."""
    e = events.withWatermark("ts", late) if late and events.isStreaming else events
    return e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
