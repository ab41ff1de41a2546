"""Rolling bus features and the five-value temporal feature vector."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from canlake.functions.encodings import id_value
from canlake.operators.deltas import last_frames_before
from canlake.operators.ordering import BLOCK_ROWS, Layout, with_halo
from canlake.storage import settle

# Fixed values of the two bus-load variants.
FULL_LOAD_RATE = 5000.0
SHORTEST_SPAN = 1e-4
NO_SPAN = 1e-6


def with_rolling(frames: DataFrame, width: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``freq_id`` and the time ``width`` frames ago (``t_back``, null early in the session).

    ``freq_id`` is the share of the last ``width`` bus frames, this one included,
    that carry the same identifier.  Both come from one shuffle by block.
    """
    bus = W.partitionBy("session_id", "block").orderBy("pos")
    same_id = (
        W.partitionBy("session_id", "block", "Arbitration_ID").orderBy("pos").rangeBetween(-(width - 1), 0)
    )
    return (
        with_halo(frames, before=width, block_rows=block_rows)
        .withColumn("t_back", F.lag("Timestamp", width).over(bus))
        .withColumn("freq_id", F.count(F.lit(1)).over(same_id) / F.lit(float(width)))
        .where("core")
        .drop("block", "core")
    )


def with_temporal(frames: DataFrame, width: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``Delta_Id``, ``freq_id`` and ``t_back`` from one exchange of frames.

    A block gets the ``width`` frames before it, and for every identifier the last frame
    before it (a carry: it serves the delta and is never counted).  Windows by (session, block) and by
    (session, block, identifier) then share the partitioning by (session, block).
    """
    last = settle(last_frames_before(frames, block_rows), "carries")
    blocked = with_halo(frames, before=width, block_rows=block_rows).withColumn("carry", F.lit(False))
    rows = blocked.unionByName(last.withColumn("carry", F.lit(True)), allowMissingColumns=True).repartition("session_id", "block")
    bus = W.partitionBy("session_id", "block").orderBy("pos")
    same_id = W.partitionBy("session_id", "block", "Arbitration_ID").orderBy("pos")
    real = ~F.col("carry")
    return (
        rows.withColumn("Delta_Id", F.coalesce(F.col("Timestamp") - F.lag("Timestamp").over(same_id), F.lit(0.0)))
        .withColumn("freq_id", F.count(F.when(real, 1)).over(same_id.rangeBetween(-(width - 1), 0)) / F.lit(float(width)))
        .withColumn("t_back", F.max(F.when(real, F.col("Timestamp"))).over(bus.rangeBetween(-width, -width)))
        .where("core")
        .drop("block", "core", "carry")
    )


def with_time_back(frames: DataFrame, width: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``t_back`` alone, from sessions, positions and times."""
    bus = W.partitionBy("session_id", "block").orderBy("pos")
    return (
        with_halo(frames, before=width, block_rows=block_rows)
        .withColumn("t_back", F.lag("Timestamp", width).over(bus))
        .where("core")
        .drop("block", "core")
    )


def session_peaks(frames: DataFrame, layout: Layout, width: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The greatest window rate of each session, from times and positions alone."""
    times = with_time_back(frames.select("session_id", "pos", "Timestamp"), width, block_rows)
    rates = with_session_bounds(times, layout).withColumn("rate", window_rate(width))
    return settle(rates.groupBy("session_id").agg(F.max("rate").alias("peak")), "peak-rates")


def span_since(width_back: str = "t_back"):
    """Time covered by the rolling window; early frames reach back to the session start."""
    return F.col("Timestamp") - F.coalesce(F.col(width_back), F.col("t_first"))


def fixed_scale_load(width: int):
    """Frames per second over the window against a full bus, clipped to [0, 1]."""
    span = span_since()
    rate = F.when(span > NO_SPAN, F.lit(float(width)) / F.greatest(span, F.lit(SHORTEST_SPAN))).otherwise(0.0)
    return F.least(F.greatest(rate / FULL_LOAD_RATE, F.lit(0.0)), F.lit(1.0))


def window_rate(width: int):
    span = span_since()
    return F.when(span > NO_SPAN, F.lit(float(width)) / span).otherwise(0.0)


def progress(stretch_short: bool):
    """Relative time in the session; a zero-length session divides by 1e-6 or by 1."""
    span = F.col("t_last") - F.col("t_first")
    whole = F.when(span <= NO_SPAN, 1.0).otherwise(span) if stretch_short else F.greatest(span, F.lit(NO_SPAN))
    return (F.col("Timestamp") - F.col("t_first")) / whole


def with_session_bounds(frames: DataFrame, layout: Layout) -> DataFrame:
    return frames.join(layout.sessions.select("session_id", "t_first", "t_last"), "session_id")


def with_fixed_load(layout: Layout, width: int, rolled: DataFrame | None = None) -> DataFrame:
    """Load against a full bus; ``rolled`` are frames that have ``t_back`` already."""
    base = with_time_back(layout.frames, width) if rolled is None else rolled
    return with_session_bounds(base, layout).withColumn("bus_load", fixed_scale_load(width))


def with_session_max_load(layout: Layout, width: int, rolled: DataFrame | None = None) -> DataFrame:
    """Load relative to the busiest window of the session (1 if there is none)."""
    base = with_time_back(layout.frames, width) if rolled is None else rolled
    rates = with_session_bounds(base, layout).withColumn("rate", window_rate(width))
    peaks = session_peaks(layout.frames, layout, width)
    return (
        rates.join(peaks, "session_id")
        .withColumn("bus_load", F.col("rate") / F.when(F.col("peak") > 0, F.col("peak")).otherwise(1.0))
        .drop("peak")
    )


def with_five_features(layout: Layout, width: int, session_max: bool = False) -> DataFrame:
    """``features``: identifier share, same-id gap, identifier frequency, bus load, progress."""
    loaded = (with_session_max_load if session_max else with_fixed_load)(layout, width, with_temporal(layout.frames, width))
    return loaded.withColumn(
        "features",
        F.array(
            id_value().bitwiseAND(0x7FF) / F.lit(2047.0),
            F.col("Delta_Id"),
            F.col("freq_id"),
            F.col("bus_load"),
            progress(stretch_short=session_max),
        ),
    ).drop("t_back", "t_first", "t_last")
