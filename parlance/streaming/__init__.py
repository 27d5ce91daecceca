"""Streaming forms of the operators: windows over event time, the newest partial, and what is new since last time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counted(events: DataFrame, length: str, slide: str | None = None, late: str = "1 hour", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """events (ts, value) by tumbling or sliding windows; rows later than `late` are left out of a stream."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    out = marked.groupBy(F.window("ts", length, slide) if slide else F.window("ts", length), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "1 hour", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Runs of events that no gap parts, by session window."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    out = marked.groupBy(F.session_window("ts", gap), *by).agg(F.count("*").alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, "n")


def finals(results: DataFrame) -> DataFrame:
    """Results that stay; partial ones never reach the transcript."""
    return results.where("is_final").where(F.trim(F.coalesce("text", F.lit(""))) != "")


def latest_partial(results: DataFrame) -> DataFrame:
    """session_id, text of the newest result if it is a partial one: a final one takes its place."""
    newest = F.max_by(F.struct("text", "is_final"), "at").alias("x")
    return results.groupBy("session_id").agg(newest).where("not x.is_final").select("session_id", "x.text")


def shed(results: DataFrame, waiting: Column, rate: Column, most: float = 0.75) -> DataFrame:
    """Partial results are dropped while others wait or the engine is slower than `most` of real time; final ones stay."""
    return results.where(F.col("is_final") | ((waiting == 0) & (rate <= most)))


def sink(stream: DataFrame, write, checkpoint: str):
    """Every batch of the stream through write(rows, batch_id), which may see a batch again after a failure, until all
    that is there now has been read."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
