"""Parquet and JSON tables in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from canlake.operators.splits import SPLITS
from canlake.schemas import BYTE_COLUMNS, require_columns

GROUP_ROWS = 100_000
# Columns the window operators can use; whatever a table has of them is read.
FRAME_COLUMNS = [
    "session_id", "Timestamp", "row_id", "Arbitration_ID", "DLC", "Class", "Delta_Id", "Deltatime",
    *BYTE_COLUMNS,
]


def read_frames(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A frame table with the wanted columns it has; the scan reads no others."""
    table = spark.read.parquet(path)
    wanted = columns or FRAME_COLUMNS
    return table.select(*[c for c in wanted if c in table.columns])


def count_rows(spark: SparkSession, path: str) -> DataFrame:
    """Row count as a one-row table, answered from Parquet footers."""
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows"))


def write_frames(frames: DataFrame, path: str, mode: str = "error", group_rows: int = GROUP_ROWS) -> None:
    """Zstd Parquet in row groups of ``group_rows``, by session inside each file; the commit is atomic.

    Frames come in file order, so they are sorted where they lie.  A slice of one session
    then reads the few groups whose session range holds it.
    """
    require_columns(frames, ["row_id"], "frame table")
    order = [c for c in ("session_id", "row_id") if c in frames.columns]
    (
        frames.sortWithinPartitions(*order)
        .write.mode(mode)
        .option("compression", "zstd")
        .option("parquet.block.row.count.limit", group_rows)
        .parquet(path)
    )


def write_splits(split_table: DataFrame, path: str, mode: str = "error") -> None:
    """One folder per split; a split without rows simply has no folder."""
    require_columns(split_table, ["split"], "split table")
    split_table.write.mode(mode).partitionBy("split").option("compression", "zstd").parquet(path)


def read_split(spark: SparkSession, path: str, name: str, schema: T.StructType) -> DataFrame:
    """One split; with the given schema also when it is empty."""
    if name not in SPLITS:
        raise ValueError(f"unknown split {name!r}; known: {list(SPLITS)}")
    full = T.StructType([f for f in schema.fields if f.name != "split"] + [T.StructField("split", T.StringType())])
    return spark.read.schema(full).parquet(path).where(F.col("split") == name).drop("split")


def write_report(report: DataFrame, path: str, mode: str = "error") -> None:
    """A report table as JSON lines."""
    report.write.mode(mode).json(path)
