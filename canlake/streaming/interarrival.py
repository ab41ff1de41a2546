"""Live inter-arrival time per (session, identifier)."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from heapq import merge
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "session_id string, Arbitration_ID string, row_id long, Timestamp double, Delta_Id double, late boolean"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows that one state entry of a set-aside chunk holds.
BLOCK_ROWS = 4096


def event_time():
    """The float seconds of a frame as a timestamp."""
    return F.timestamp_micros(F.round(F.col("Timestamp") * 1e6).cast("long"))


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, on disk and by key."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)


class InterArrival(StatefulProcessor):
    """Delta to the previous frame of the key; one number of state for each key.

    A micro-batch brings a key's frames in chunks, in any order.  A single chunk is
    sorted at once.  Of several, each is sorted and set aside in the state store block by
    block, and the chunks are merged from there, so that memory holds one block of each
    chunk, however many frames the key has; the blocks leave the store as they are read.
    """

    def __init__(self, expire_ms: int | None = None, block_rows: int = BLOCK_ROWS):
        self.expire_ms, self.block_rows = expire_ms, block_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "time double", self.expire_ms)
        self.aside = handle.getMapState("aside", "chunk int, block int", "times array<double>, row_ids array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        chunks = (self._sorted(chunk) for chunk in rows)
        first, second = next(chunks), next(chunks, None)
        ordered = [first] if second is None else self._merged(chain([first, second], chunks))
        seen = self.last.get()[0] if self.last.exists() else None
        newest = seen
        for times, row_ids in ordered:
            late = times < seen if seen is not None else np.zeros(len(times), dtype=bool)
            good = times[~late]
            deltas = np.full(len(times), np.nan)
            if len(good):
                before = good[0] if newest is None else newest
                deltas[~late] = np.diff(good, prepend=before)
                newest = float(good[-1])
            yield pd.DataFrame({
                "session_id": key[0], "Arbitration_ID": key[1], "row_id": row_ids, "Timestamp": times,
                "Delta_Id": pd.Series(deltas).where(~late, None), "late": late,
            })
        if newest is not None:
            self.last.update((newest,))

    @staticmethod
    def _sorted(chunk: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        times, row_ids = chunk["Timestamp"].to_numpy(), chunk["row_id"].to_numpy()
        order = np.lexsort((row_ids, times))
        return times[order], row_ids[order]

    def _merged(self, chunks) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        blocks = []
        for i, (times, row_ids) in enumerate(chunks):
            blocks.append(-(-len(times) // self.block_rows))
            for b in range(blocks[-1]):
                part = slice(b * self.block_rows, (b + 1) * self.block_rows)
                self.aside.updateValue((i, b), (times[part].tolist(), row_ids[part].tolist()))

        def frames_of(i: int) -> Iterator[tuple[float, int]]:
            for b in range(blocks[i]):
                times, row_ids = self.aside.getValue((i, b))
                self.aside.removeKey((i, b))
                yield from zip(times, row_ids)

        held: list[tuple[float, int]] = []
        for frame in merge(*map(frames_of, range(len(blocks)))):
            held.append(frame)
            if len(held) == self.block_rows:
                yield self._columns(held)
                held = []
        if held:
            yield self._columns(held)

    @staticmethod
    def _columns(frames: list[tuple[float, int]]) -> tuple[np.ndarray, np.ndarray]:
        return np.array([t for t, _ in frames]), np.array([r for _, r in frames], np.int64)

    def close(self) -> None:
        pass


def live_delta_id(frames: DataFrame, expire_ms: int | None = None) -> DataFrame:
    """``Delta_Id`` on a stream of frames, keeping one number per (session, identifier).

    Frames without a time are left out.  A frame older than the last one seen of its key in an
    earlier batch is marked ``late`` and gets no delta; it is never dropped, so rows out equal rows in.
    There is no watermark, which would filter late frames uncounted.  A key that has been silent for ``expire_ms`` of
    wall-clock time is forgotten; by default none is.  Start the stream within ``rocksdb_state``.
    """
    return (
        frames.select("session_id", "Arbitration_ID", "row_id", "Timestamp")
        .where("Timestamp IS NOT NULL")
        .groupBy("session_id", "Arbitration_ID")
        .transformWithStateInPandas(
            InterArrival(expire_ms), OUTPUT, "append", "none" if expire_ms is None else "processingTime"
        )
    )


def late_counts(deltas: DataFrame) -> DataFrame:
    """Late frames per session out of the written deltas."""
    return deltas.groupBy("session_id").agg(F.count_if("late").alias("late_frames"))
