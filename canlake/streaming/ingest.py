"""Continuous ingest of new capture files into canonical Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from canlake.sources.captures import canonical_order, parser_for
from canlake.sources.discovery import dialect_glob, file_stem, is_excluded, select_captures
from canlake.sources.parsing import accepted


def capture_stream(spark: SparkSession, folder: str, dialect: str, files_per_batch: int | None = None) -> DataFrame:
    """Lines of files as they appear; a file always arrives whole in one micro-batch."""
    reader = (
        spark.readStream.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", dialect_glob(dialect))
        .schema("value string")
    )
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    path = F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B"))
    return (
        reader.format("text")
        .load(folder)
        .select(path.alias("path"), F.col("_metadata.file_block_start").alias("file_block"), "value")
        .withColumn("session_id", file_stem(F.col("path")))
    )


def ingest_new_captures(
    spark: SparkSession,
    folder: str,
    dialect: str,
    output: str,
    checkpoint: str,
    injections: DataFrame | None = None,
    variant: str | None = None,
    exclude: list[str] | None = None,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Parse what is new and stop; run again (or on a schedule) for later files.

    Each micro-batch overwrites its own folder, so a repeated batch does not add
    frames twice; the folder carries the stream's id, which its checkpoint keeps, so
    streams with other checkpoints can share ``output``.  Frames are keyed by (path, file_block, line_key): a dense
    ``row_id`` would need all files and belongs to the batch ingest.
    """
    parse = parser_for(dialect, injections)

    def write_batch(lines: DataFrame, batch: int) -> None:
        stream = lines.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        if not stream:
            raise RuntimeError("no id of the stream: its batches could overwrite another's")
        keyed = lines.withColumn("line_key", F.monotonically_increasing_id())
        if exclude:
            keyed = keyed.where(~is_excluded(F.col("path"), folder, exclude))
        frames = accepted(parse(select_captures(keyed, dialect, variant)))
        (
            frames.select("path", "file_block", "line_key", *canonical_order(frames).columns)
            .write.mode("overwrite")
            .option("compression", "zstd")
            .parquet(f"{output}/stream={stream}/batch={batch}")
        )

    return (
        capture_stream(spark, folder, dialect, files_per_batch)
        .writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
