"""Document frequencies of hashed terms in an array of fixed size.

Every document adds one to the counter of each of its distinct terms.  The array is
counted in every task, compressed, and summed by chunks in a shuffle, so its size is the
same for any corpus; a counter is never below the frequency of a term that it holds.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from canlake.llm import kernels as K

BITS = 21
CHUNKS = 128


def counter_of(terms: np.ndarray) -> np.ndarray:
    return (terms >> np.uint64(64 - BITS)).astype(np.int64)


def document_counts(texts: DataFrame, terms_of: Callable) -> tuple[np.ndarray, int]:
    """The counters over all rows of ``texts`` (text) and the number of rows.

    ``terms_of(data, offsets)`` gives the distinct terms of each row and their offsets.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(1 << BITS, np.uint32), 0
        for batch in batches:
            data, offsets = K.text_buffers(batch.column(0))
            rows += len(offsets) - 1
            for a, b in K.slices(data, offsets, 16 * K.BLOCK):
                terms, _ = terms_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                total += np.bincount(counter_of(terms), minlength=1 << BITS).astype(np.uint32)
        pieces = total.reshape(CHUNKS, -1)
        full = [i for i in range(CHUNKS) if pieces[i].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *full], pa.int32()), pa.array([rows, *[0] * len(full)], pa.int64()),
             pa.array([b"", *(zlib.compress(pieces[i].tobytes(), 1) for i in full)], pa.binary())],
            names=["chunk", "n", "counts"],
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        rows = 0
        for batch in batches:
            for chunk, n, counts in zip(*(batch.column(i).to_pylist() for i in range(3))):
                rows += n
                if counts:
                    found = np.frombuffer(zlib.decompress(counts), np.uint32).astype(np.uint64)
                    sums[chunk] = sums[chunk] + found if chunk in sums else found
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *sums], pa.int32()), pa.array([rows, *[0] * len(sums)], pa.int64()),
             pa.array([b"", *(v.tobytes() for v in sums.values())], pa.binary())],
            names=["chunk", "n", "counts"],
        )

    schema = "chunk int, n long, counts binary"
    total, rows = np.zeros((CHUNKS, (1 << BITS) // CHUNKS), np.uint64), 0
    # At most CHUNKS rows with 16 MB together come to the driver.
    for row in texts.select("text").mapInArrow(count, schema).repartition("chunk").mapInArrow(add, schema).toLocalIterator():
        rows += row["n"]
        if row["chunk"] >= 0:
            total[row["chunk"]] += np.frombuffer(row["counts"], np.uint64)
    return total.reshape(-1), rows
