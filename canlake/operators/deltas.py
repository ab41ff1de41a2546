"""Inter-arrival times: since the previous frame, and since the same identifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from canlake.operators.ordering import BLOCK_ROWS, block_of, with_halo


def with_deltatime(frames: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``Deltatime``: seconds since the previous frame of the session, 0 for the first."""
    inside = W.partitionBy("session_id", "block").orderBy("pos")
    return (
        with_halo(frames, before=1, block_rows=block_rows)
        .withColumn("Deltatime", F.coalesce(F.col("Timestamp") - F.lag("Timestamp").over(inside), F.lit(0.0)))
        .where("core")
        .drop("block", "core")
    )


def last_frames_before(frames: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """For each identifier and block it sends in, its last frame before the block (``core`` is false)."""
    along = W.partitionBy("session_id", "Arbitration_ID").orderBy("block")
    return (
        frames.groupBy("session_id", "Arbitration_ID", block_of("pos", block_rows).alias("block"))
        .agg(F.max_by("Timestamp", "pos").alias("last_time"), F.max("pos").alias("last_pos"))
        .select(
            "session_id", "Arbitration_ID", "block",
            F.lag("last_pos").over(along).alias("pos"),
            F.lag("last_time").over(along).alias("Timestamp"),
            F.lit(False).alias("core"),
        )
        .where("pos IS NOT NULL")
    )


def with_delta_id(frames: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``Delta_Id``: seconds since the previous frame with the same identifier, else 0.

    Works block by block.  The last frame an identifier sent before a block is
    added to that block as a carry row; carries come from a per-block maximum, so
    one busy identifier never collects in one task.
    """
    blocked = frames.withColumn("block", block_of("pos", block_rows)).withColumn("core", F.lit(True))
    carries = last_frames_before(frames, block_rows)
    inside = W.partitionBy("session_id", "block", "Arbitration_ID").orderBy("pos")
    return (
        blocked.unionByName(carries, allowMissingColumns=True)
        .withColumn("Delta_Id", F.coalesce(F.col("Timestamp") - F.lag("Timestamp").over(inside), F.lit(0.0)))
        .where("core")
        .drop("block", "core")
    )


def with_relative_time(frames: DataFrame, sessions: DataFrame) -> DataFrame:
    """``relative_time``: seconds since the first frame of the session."""
    first = sessions.select("session_id", "t_first")
    return (
        frames.join(first, "session_id")
        .withColumn("relative_time", F.col("Timestamp") - F.col("t_first"))
        .drop("t_first")
    )


def nonzero_first_deltas(prepared: DataFrame) -> DataFrame:
    """Sessions whose first frame has a delta: a sign of features crossing sessions."""
    return prepared.where((F.col("pos") == 0) & (F.col("Deltatime") != 0.0)).select(
        "session_id", "row_id", "Deltatime"
    )
