"""Incremental ingest: new shards since the last run become articles and links."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.text import extract_links
from lexmill.functions.tokenizers import word
from lexmill.schemas import DUMP
from lexmill.sources.dumps import SHARD, decode


def stream_records(spark: SparkSession, root: str, files_per_batch: int = 1000) -> DataFrame:
    """An unbounded table of dump records; shards are picked up as they appear."""
    reader = spark.readStream.schema(DUMP).option("maxFilesPerTrigger", files_per_batch)
    return reader.json(f"{root.rstrip('/')}/*/{SHARD}").select("*", F.col("_metadata.file_path").alias("file"))


def ingest_new(spark: SparkSession, root: str, out: str, checkpoint: str, tokens: Callable[[Column], Column] = word, exact_html: bool = True) -> int:
    """Append the articles and links of the shards that are new since the last call, then stop; the batches run.

    Each batch appends ``<out>/article_load`` (with ``loaded_at``) and ``<out>/internal_link_load``; batches are written under
    their number, so a batch run again after a failure replaces itself. What has been read is kept in ``checkpoint``.
    """

    def write(batch: DataFrame, number: int) -> None:
        decoded = decode(batch, tokens, exact_html).withColumn("loaded_at", F.current_timestamp())
        decoded.persist()
        try:
            articles = decoded.select(F.col("page_id").alias("article_id"), "page_id", "title", "plain_text_paragraphs", "paragraph_token_counts", "is_disambiguation", "loaded_at")
            articles.write.mode("overwrite").parquet(f"{out}/article_load/batch={number}")
            extract_links(decoded).withColumn("loaded_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{out}/internal_link_load/batch={number}")
        finally:
            decoded.unpersist()

    query = stream_records(spark, root).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len([p for p in query.recentProgress if p["numInputRows"]])


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events of each type by window, late ones up to ``late``: ``(window_start, event_type, n, total)``; batch or stream."""
    seen = events.withWatermark("ts", late) if events.isStreaming else events
    out = seen.groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")
