"""Train/val/test assignment of frames and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from canlake.operators import sampling as smp
from canlake.operators.windows import candidate_windows, last_frame_windows, window_references
from canlake.schemas import LabelSchema, check_split_ratios
from canlake.storage import settle

SPLITS = ("train", "val", "test")


def cut_points(size: int, val_ratio: float, test_ratio: float) -> tuple[int, int]:
    """Ranks below the first bound train, below the second validate, the rest test."""
    check_split_ratios(val_ratio, test_ratio)
    n_val, n_test = int(size * val_ratio), int(size * test_ratio)
    n_train = size - n_val - n_test
    return n_train, n_train + n_val


def split_of_rank(rank: str, label: str, sizes: dict[int, int], val_ratio: float, test_ratio: float) -> Column:
    chosen = None
    for value, size in sorted(sizes.items()):
        train_end, val_end = cut_points(size, val_ratio, test_ratio)
        here = (
            F.when(F.col(rank) < train_end, "train").when(F.col(rank) < val_end, "val").otherwise("test")
        )
        chosen = F.when(F.col(label) == value, here) if chosen is None else chosen.when(F.col(label) == value, here)
    return chosen


def stratified_frames(
    frames: DataFrame, val_ratio: float = 0.2, test_ratio: float = 0.2, seed: int = 42
) -> DataFrame:
    """Per class, a permuted share of the frames to each split; adds ``split``."""
    check_split_ratios(val_ratio, test_ratio)
    ordered, sizes = smp.with_class_ordinal(frames, "Class", "row_id")
    ranked = smp.with_permuted(ordered, "rank", "ordinal", "Class", sizes, seed, smp.STREAM_FRAMES)
    return ranked.withColumn("split", split_of_rank("rank", "Class", sizes, val_ratio, test_ratio)).drop(
        "ordinal", "ordinal_total", "rank"
    )


def check_holdout(known: DataFrame, val_sessions: list[str], test_sessions: list[str]) -> None:
    """Configured sessions must exist and must not be in both lists."""
    both = sorted(set(val_sessions) & set(test_sessions))
    if both:
        raise ValueError(f"sessions in both validation and test: {both}")
    named = sorted(set(val_sessions) | set(test_sessions))
    if not named:
        return
    found = {r[0] for r in known.where(F.col("session_id").isin(named)).select("session_id").distinct().collect()}
    absent = sorted(set(named) - found)
    if absent:
        raise ValueError(f"sessions that do not exist: {absent}")


def holdout_split(val_sessions: list[str], test_sessions: list[str]) -> Column:
    session = F.col("session_id")
    return (
        F.when(session.isin(*val_sessions), "val").when(session.isin(*test_sessions), "test").otherwise("train")
        if val_sessions or test_sessions
        else F.lit("train")
    )


def holdout_frames(frames: DataFrame, val_sessions: list[str], test_sessions: list[str]) -> DataFrame:
    """Whole sessions to val and test, the rest to train: a column, no shuffle."""
    check_holdout(frames, val_sessions, test_sessions)
    return frames.withColumn("split", holdout_split(val_sessions, test_sessions))


def sessions_subset(frames: DataFrame, sessions: DataFrame) -> DataFrame:
    """Frames of the sessions in a list table."""
    return frames.join(sessions.select("session_id"), "session_id", "left_semi")


def stratified_windows(
    frames: DataFrame,
    size: int,
    stride: int,
    schema: LabelSchema,
    val_ratio: float = 0.2,
    test_ratio: float = 0.2,
    downsample: bool = False,
    downsample_size: int | None = None,
    seed: int = 42,
    positions: bool = False,
) -> DataFrame:
    """Window references with first-attack labels, split per class; adds ``split``."""
    check_split_ratios(val_ratio, test_ratio)
    # The index is counted and then numbered: written once, worked out once.
    index = settle(window_references(candidate_windows(frames, size, stride, schema), size, positions), "window-index")
    ordered, sizes = smp.with_class_ordinal(index, "label", "start_row_id")
    if not sizes:
        raise ValueError("no session is long enough for a window")
    if downsample or downsample_size is not None:
        target = smp.balanced_target(sizes, downsample_size)
        drawn = smp.with_permuted(ordered, "drawn", "ordinal", "label", sizes, seed, smp.STREAM_DOWNSAMPLE)
        ordered = drawn.where(F.col("drawn") < target).drop("ordinal").withColumnRenamed("drawn", "ordinal")
        sizes = {label: target for label in sizes}
    ranked = smp.with_permuted(ordered, "rank", "ordinal", "label", sizes, seed, smp.STREAM_WINDOWS)
    return ranked.withColumn("split", split_of_rank("rank", "label", sizes, val_ratio, test_ratio)).drop(
        "ordinal", "ordinal_total", "rank"
    )


def holdout_windows(
    frames: DataFrame, size: int, stride: int, val_sessions: list[str], test_sessions: list[str]
) -> DataFrame:
    """Window references with last-frame labels, split by session; adds ``split``."""
    check_holdout(frames, val_sessions, test_sessions)
    index = window_references(last_frame_windows(frames, size, stride), size)
    return index.withColumn("split", holdout_split(val_sessions, test_sessions))
