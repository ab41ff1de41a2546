"""Packing by deficit round-robin over source queues.

Each source is a queue of documents (ascending doc_id), cut into packets of at most
``PACKET`` ids.  One round adds ``window x share`` ids to a source's deficit and serves
its packets while they fit; what a source could not use is carried to the next round.
A packet is therefore served in round ``ceil(end / quantum)``, where ``end`` is the number
of its queue's ids up to and with it: the deficit carried across windows and partitions
is exactly the remainder of that prefix sum, so the rounds need no sequential loop.
Packets in the order (round, source, queue place) fill windows without a gap; only the
last window can be short.

Shares default to the sources' shares of all ids, so all queues run dry together; a
queue that is dry under other weights leaves its turns to the rest.  Null texts count as
empty (the end id alone), a null source is a source of its own, rows with the same doc_id
are packed separately, an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canlake.llm import kernels as K
from canlake.llm.common import running_total, same, table
from canlake.llm.tokens import ID_TYPE, VOCABULARY, tokenised
from canlake.storage import settle

WINDOW_IDS = 1024
PACKET = 256
END_ID = 0
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, weights: DataFrame | None = None, window: int = WINDOW_IDS, packet: int = PACKET,
         end_id: int = END_ID, vocabulary: str = VOCABULARY) -> DataFrame:
    """Pieces of all documents with their places in sequences of ``window`` ids.

    ``weights`` (source, weight): target proportions; a source without a positive weight
    takes its share of the ids.
    """
    stored = settle(
        tokenised(docs.select("doc_id", "source", "text"), ["doc_id", "source"], end_id, vocabulary)
        .withColumn("row_key", F.monotonically_increasing_id()),
        "pack-ids",
    )
    queues = running_total(stored.select("row_key", "doc_id", "source", "n_tokens"), ["source"], ["doc_id", "row_key"], "n_tokens", "before", "queue")
    sizes = settle(stored.groupBy("source").agg(F.sum("n_tokens").cast("double").alias("weight")), "pack-sizes")
    if weights is not None:
        given = weights.select("source", F.col("weight").cast("double").alias("given"))
        joined = sizes.join(given, same(sizes, given, ["source"]), "left")
        sizes = joined.select(sizes["source"], F.when(F.col("given") > 0, F.col("given")).otherwise(F.col("weight")).alias("weight"))
    total = sizes.agg(F.sum("weight")).first()[0] or 1.0
    quanta = sizes.select("source", (F.col("weight") * F.lit(window / total)).alias("quantum"))
    placed = queues.join(quanta, same(queues, quanta, ["source"])).select(queues["source"], "row_key", "n_tokens", "before", "quantum")
    packets = placed.select(
        "source", "row_key", "before", "quantum", "n_tokens",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_tokens") - 1, F.lit(packet).cast("long"))).alias("start"),
    ).withColumn("length", F.least(F.lit(packet).cast("long"), F.col("n_tokens") - F.col("start")))
    packets = settle(
        packets.select(
            "source", "row_key", "start", "length", (F.col("before") + F.col("start")).alias("place"),
            F.ceil((F.col("before") + F.col("start") + F.col("length")) / F.col("quantum")).alias("round"),
        ),
        "pack-packets",
    )
    served = running_total(packets, [], ["round", "source", "place"], "length", "at", "pack-order")
    # A packet is no longer than a window, so it meets two windows at most.
    head = F.least(F.col("length"), F.lit(window) - F.pmod(F.col("at"), F.lit(window)))
    pieces = served.withColumn("head", head).select("row_key", F.explode(F.array(
        F.struct(F.col("start"), F.col("head").alias("length"), F.col("at")),
        F.struct((F.col("start") + F.col("head")).alias("start"), (F.col("length") - F.col("head")).alias("length"), (F.col("at") + F.col("head")).alias("at")),
    )).alias("piece")).where("piece.length > 0")
    by_document = pieces.groupBy("row_key").agg(F.sort_array(F.collect_list("piece")).alias("pieces"))
    joined = stored.select("row_key", "doc_id", "ids").join(by_document, "row_key").select("doc_id", "ids", "pieces")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = np.dtype(ID_TYPE).itemsize
        for batch in batches:
            data, offsets = K.text_buffers(batch.column("ids"))
            lists = batch.column("pieces")
            fields = lists.flatten()
            start, length, at = (fields.field(i).to_numpy() for i in range(3))
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            if not len(row):
                continue
            # Pieces of one document that lie side by side in one window are one piece.
            fresh = np.ones(len(row), dtype=bool)
            fresh[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + length[:-1]) | (at[1:] % window == 0)
            first = np.flatnonzero(fresh)
            length = np.add.reduceat(length, first)
            row, start, at = row[first], start[first], at[first]
            begin = offsets[row] + start * width
            wide = data.view(ID_TYPE).astype("<u4")
            begin //= width
            crc = [zlib.crc32(wide[a : a + n]) for a, n in zip(begin.tolist(), length.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()),
                 pa.array((np.diff(offsets) // width)[row]), pa.array(at // window), pa.array(at % window)],
                names=[c.split()[0] for c in PIECES.split(", ")],
            )

    return joined.mapInArrow(digest, PIECES)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 1024 ids."""
    return pack(table(spark, sf_dir, "documents"))
