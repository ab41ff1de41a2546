"""Normalisation statistics of the nine numeric frame fields, and their use."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from canlake.functions import encodings as enc
from canlake.functions.hexfields import VALUES, decoded, or_zero
from canlake.schemas import BYTE_COLUMNS

NUMERIC_COLUMNS = ["DLC", *BYTE_COLUMNS]
SMALLEST_STD = 1e-8


@dataclass(frozen=True)
class NormStats:
    """Means and deviations of the training data, in ``NUMERIC_COLUMNS`` order."""

    columns: tuple[str, ...]
    mean: tuple[float, ...]
    std: tuple[float, ...]

    def __post_init__(self):
        if list(self.columns) != NUMERIC_COLUMNS:
            raise ValueError(f"statistics are for {list(self.columns)}, the vector has {NUMERIC_COLUMNS}")


def numeric(name: str) -> Column:
    """A numeric field of a decoded frame."""
    return (F.col("DLC") if name == "DLC" else or_zero(VALUES[BYTE_COLUMNS.index(name)])).cast("double")


def usable(std: Column) -> Column:
    """A constant column divides by one."""
    return F.when(std < SMALLEST_STD, F.lit(1.0)).otherwise(std)


def in_rows(wide: DataFrame) -> DataFrame:
    """One row per column out of ``<name>_mean`` / ``<name>_std`` pairs."""
    entries = [
        F.struct(F.lit(name).alias("column"), F.col(f"{name}_mean").alias("mean"), usable(F.col(f"{name}_std")).alias("std"))
        for name in NUMERIC_COLUMNS
    ]
    return wide.select(F.inline(F.array(*entries)))


def frame_stats(frames: DataFrame) -> DataFrame:
    """Mean and population deviation per numeric column over frames."""
    return in_rows(
        decoded(frames).agg(
            *[F.avg(numeric(n)).alias(f"{n}_mean") for n in NUMERIC_COLUMNS],
            *[F.stddev_pop(numeric(n)).alias(f"{n}_std") for n in NUMERIC_COLUMNS],
        )
    )


def window_count(size: int, stride: int) -> Column:
    """How many full windows of the session contain a frame (``n_frames`` long session)."""
    last_start = F.floor((F.col("n_frames") - size) / F.lit(stride))
    highest = F.least(F.floor(F.col("pos") / F.lit(stride)), last_start)
    lowest = F.greatest(F.ceil((F.col("pos") - (size - 1)) / F.lit(stride)), F.lit(0))
    return F.greatest(highest - lowest + 1, F.lit(0))


def window_stats(frames: DataFrame, sessions: DataFrame, size: int, stride: int) -> DataFrame:
    """Same figures when every full window counts its frames: a weighted single pass."""
    weighted = decoded(frames).join(sessions.select("session_id", "n_frames"), "session_id").withColumn(
        "w", window_count(size, stride).cast("double")
    )
    sums = weighted.agg(
        F.sum("w").alias("w"),
        *[F.sum(F.col("w") * numeric(n)).alias(f"{n}_s") for n in NUMERIC_COLUMNS],
        *[F.sum(F.col("w") * numeric(n) * numeric(n)).alias(f"{n}_q") for n in NUMERIC_COLUMNS],
    )
    total = F.greatest(F.col("w"), F.lit(1.0))
    moments = sums.select(
        *[(F.col(f"{n}_s") / total).alias(f"{n}_mean") for n in NUMERIC_COLUMNS],
        *[
            F.sqrt(
                F.greatest(F.col(f"{n}_q") / total - F.pow(F.col(f"{n}_s") / total, F.lit(2.0)), F.lit(0.0))
            ).alias(f"{n}_std")
            for n in NUMERIC_COLUMNS
        ],
    )
    return in_rows(moments)


def fit(stats: DataFrame) -> NormStats:
    """Bring the nine means and deviations to the driver, to be used as literals."""
    rows = {r["column"]: r for r in stats.collect()}
    return NormStats(
        tuple(NUMERIC_COLUMNS),
        tuple(rows[n]["mean"] for n in NUMERIC_COLUMNS),
        tuple(rows[n]["std"] for n in NUMERIC_COLUMNS),
    )


def scaled_values(stats: NormStats) -> list[Column]:
    """The nine numeric fields as z-scores of the training statistics."""
    return [(x - F.lit(m)) / F.lit(s) for x, m, s in zip(enc.numeric_values(), stats.mean, stats.std)]


def scaled_frame_vector(stats: NormStats, width: int = 11) -> Column:
    """Identifier bits as they are, numeric fields as z-scores; needs a decoded frame."""
    return F.array(*[b.cast("double") for b in enc.bits(F.col(enc.ID), width)], *scaled_values(stats))
