"""Late frames split off a stream before its watermark, so that none is dropped uncounted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from canlake.streaming.interarrival import event_time


def _written(spark: SparkSession, path: str) -> bool:
    """Whether a batch folder is complete."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def split_late(frames: DataFrame, output: str, checkpoint: str, lateness: str = "1 second") -> StreamingQuery:
    """Writes each micro-batch to ``output``: frames on time, late frames, and how far time has come.

    A frame is late if its time lies more than ``lateness`` before the newest frame of the
    batches before its own; that is where a watermark of the same delay would drop it at the earliest.
    Frames without a time are late as well.  A batch is one folder, written in one job and
    left as it is once complete, so a repeated batch adds nothing.
    """

    def write_batch(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        folder = f"{output}/frames/batch={number}"
        if not _written(spark, folder):
            late = F.lit(False)
            if number:
                reached = spark.read.schema("newest long, batch long").parquet(f"{output}/reached").where(F.col("batch") < number)
                newest = reached.agg(F.max("newest")).first()[0]
                late = F.col("event_time") < F.timestamp_micros(F.lit(newest).cast("long")) - F.expr(f"INTERVAL {lateness}")
            marked = batch.withColumn("late", F.col("event_time").isNull() | F.coalesce(late, F.lit(False)))
            marked.write.mode("overwrite").option("compression", "zstd").partitionBy("late").parquet(folder)
        step = f"{output}/reached/batch={number}"
        if not _written(spark, step):
            newest = on_time(spark, folder, batch).agg(F.max(F.unix_micros("event_time")).alias("newest"))
            newest.write.mode("overwrite").parquet(step)

    timed = frames.withColumn("event_time", event_time())
    return timed.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _split(spark: SparkSession, folder: str, like: DataFrame, late: bool) -> DataFrame:
    schema = like.schema.add("late", "boolean")
    return spark.read.schema(schema).parquet(folder).where(F.col("late") == late).drop("late")


def on_time(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    """Frames on time below ``folder``, a batch or all of them; ``like`` has their columns."""
    return _split(spark, folder, like, False)


def late_frames(spark: SparkSession, output: str, like: DataFrame) -> DataFrame:
    """All frames that came late."""
    return _split(spark, f"{output}/frames", like, True)


def on_time_stream(spark: SparkSession, output: str, like: DataFrame) -> DataFrame:
    """The frames on time as a stream, batch after batch; none of them is behind a watermark of that lateness."""
    schema = like.schema.add("batch", "long").add("late", "boolean")
    stream = spark.readStream.schema(schema).parquet(f"{output}/frames")
    return stream.where("NOT late").drop("late", "batch")
