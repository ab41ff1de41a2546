"""The stages from raw captures to split tables, each one logical plan and one write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from canlake.functions.labels import class_id
from canlake.operators import splits
from canlake.operators.deltas import with_delta_id, with_deltatime
from canlake.operators.ordering import Layout, lay_out
from canlake.schemas import label_schema, require_columns
from canlake.sources.captures import canonical_order, parser_for, selected_lines, with_row_ids
from canlake.sources.candump import read_injections
from canlake.sources.parsing import accepted, reject_counts, staged
from canlake.sources.tables import write_frames, write_splits

FEATURES = {"deltatime": "Deltatime", "delta_id": "Delta_Id"}


def ingest(
    spark: SparkSession,
    folder: str,
    dialect: str,
    output: str,
    variant: str | None = None,
    exclude: list[str] | None = None,
    metadata: str | None = None,
) -> DataFrame:
    """Canonical frames of all selected captures; returns the reject counts."""
    injections = read_injections(spark, metadata) if metadata else None
    parse = parser_for(dialect, injections)
    parsed = staged(parse(selected_lines(spark, folder, dialect, variant, exclude)))
    frames = canonical_order(with_row_ids(accepted(parsed)))
    write_frames(frames, output)
    if spark.read.parquet(output).isEmpty():
        raise ValueError(f"no valid frame in the selected captures under {folder}")
    return reject_counts(parsed)


def prepare(frames: DataFrame, schema: str, variant: str | None = None, features=()) -> tuple[DataFrame, Layout]:
    """Class ids and the requested inter-arrival features, on an ordered layout."""
    unknown = sorted(set(features) - set(FEATURES))
    if unknown:
        raise ValueError(f"unknown features {unknown}; known: {sorted(FEATURES)}")
    label_schema(schema, variant)
    if features:
        require_columns(frames, ["Timestamp"], f"features {sorted(features)} on the frame table")
    layout = lay_out(frames.withColumn("Class", class_id(schema, variant)).drop("attack_type"))
    table = layout.frames
    if "deltatime" in features:
        table = with_deltatime(table).withColumn("Deltatime", F.col("Deltatime").cast("float"))
    if "delta_id" in features:
        table = with_delta_id(table).withColumn("Delta_Id", F.col("Delta_Id").cast("float"))
    return table, layout


def split(
    prepared: DataFrame,
    output: str,
    schema: str,
    variant: str | None = None,
    unit: str = "frame",
    strategy: str = "session_holdout",
    window_size: int = 16,
    stride: int = 8,
    val_ratio: float = 0.2,
    test_ratio: float = 0.2,
    val_sessions=(),
    test_sessions=(),
    downsample: bool = False,
    downsample_size: int | None = None,
    seed: int = 42,
) -> None:
    """Frames or window references into train, val and test folders."""
    if unit not in ("frame", "window"):
        raise ValueError(f"unit must be 'frame' or 'window', not {unit!r}")
    if strategy not in ("session_holdout", "stratified_random"):
        raise ValueError(f"unknown split strategy {strategy!r}")
    resolved = label_schema(schema, variant)
    val, test = list(val_sessions), list(test_sessions)
    if unit == "frame" and strategy == "session_holdout":
        table = splits.holdout_frames(prepared, val, test)
    elif unit == "frame":
        table = splits.stratified_frames(prepared, val_ratio, test_ratio, seed)
    elif strategy == "session_holdout":
        table = splits.holdout_windows(prepared, window_size, stride, val, test)
    else:
        table = splits.stratified_windows(
            prepared, window_size, stride, resolved, val_ratio, test_ratio, downsample, downsample_size, seed
        )
    write_splits(table, output)
