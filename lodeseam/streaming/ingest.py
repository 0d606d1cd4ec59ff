"""Incremental ingestion and event windows with Structured Streaming (beyond the batch operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.keyed import append_new


def upsert_stream(rows: DataFrame, path: str, key: str, checkpoint: str) -> StreamingQuery:
    """Append rows of a stream whose key the Parquet table at `path` lacks. A batch that is repeated after a failure adds nothing,
    as its keys are there already."""
    return rows.writeStream.foreachBatch(lambda batch, _: append_new(batch, path, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def chunk_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Chunks of new Parquet files of a folder."""
    return spark.readStream.schema(schema).parquet(path)


def windowed_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events by type and window of `ts`, rows later than `late` left out in a stream. Works on batches, too."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    source = events.withWatermark("ts", late) if events.isStreaming else events
    return source.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
