"""Tumbling bus-load windows, the same expression for batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from canlake.streaming.interarrival import event_time


def tumbling_load(frames: DataFrame, width: str = "20 milliseconds", lateness: str = "1 second") -> DataFrame:
    """Frames and distinct identifiers per session and window.

    The identifier set of one window is bounded by what a bus can carry in that time.  A stream
    in append mode gives a window once it is ``lateness`` old and drops frames that come
    later still: split those off first (``lateness.split_late``).
    """
    timed = frames if "event_time" in frames.columns else frames.withColumn("event_time", event_time())
    if frames.isStreaming:
        timed = timed.withWatermark("event_time", lateness)
    return (
        timed.groupBy("session_id", F.window("event_time", width).alias("w"))
        .agg(F.count(F.lit(1)).alias("frames"), F.size(F.collect_set("Arbitration_ID")).alias("ids"))
        .select("session_id", F.unix_micros("w.start").alias("start_us"), "frames", "ids")
    )
