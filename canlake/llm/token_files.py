"""Token-ID files: frequency ranks in byte-aligned variable-length coding.

A file row holds one document: ``control`` has two bits for each id (the number of bytes
less one, four ids to a byte, lowest bits first), ``data`` the ids' bytes one after the
other, least significant first.  An id is written as its frequency rank over the whole
corpus, so 256 ids take one byte.  The last control byte is filled up with rank 0.
``vocabulary`` next to the rows maps ranks back.  Decoding is a table lookup: a control
byte names the bytes of four 32-bit words that the data fill.

Null and empty texts hold the end id alone; rows with equal or null doc_id are all kept
(null first).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canlake.llm import kernels as K
from canlake.llm.common import partitions, table
from canlake.llm.tokens import ID_TYPE, VOCABULARY, tokenised
from canlake.storage import scratch_path, settle

END_ID = 2
#: Bytes of a file part that the writer aims at.
PART_BYTES = 64 << 20

_LENGTHS = 1 + (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3)
#: For each control byte, which bytes of four little-endian 32-bit words are present.
_PRESENT = (np.arange(4) < _LENGTHS[:, :, None]).reshape(256, 16)
_DATA_BYTES = _LENGTHS.sum(axis=1)


def encode_ranks(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control and data bytes of ranks whose number is a multiple of four."""
    words = ranks.astype("<u4")
    code = (words > 0xFF).astype(np.uint8) + (words > 0xFFFF) + (words > 0xFFFFFF)
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    return control, words.view(np.uint8).reshape(-1, 16)[_PRESENT[control]]


def decode_ranks(control: np.ndarray, data: np.ndarray) -> np.ndarray:
    """The ranks, four for each control byte."""
    words = np.zeros((len(control), 16), np.uint8)
    words[_PRESENT[control]] = data
    return words.reshape(-1).view("<u4")


def _binary(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(
        pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))]
    )


def id_counts(tokens: DataFrame) -> DataFrame:
    """(id, n) over all documents; at most one row for each vocabulary entry."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            data, _ = K.text_buffers(batch.column(0))
            found = np.bincount(data.view(ID_TYPE))
            if len(found) > len(total):
                total = np.concatenate([total, np.zeros(len(found) - len(total), np.int64)])
            total[: len(found)] += found
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], names=["id", "n"])

    return tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_token_files(docs: DataFrame, path: str, end_id: int = END_ID, vocabulary: str = VOCABULARY) -> None:
    """Writes ``path/rows`` in ascending doc_id order and ``path/vocabulary``."""
    spark = docs.sparkSession
    tokens = settle(tokenised(docs, ["doc_id"], end_id, vocabulary), "token-ids")
    # Bounded by the vocabulary, whatever the corpus.
    counts = id_counts(tokens).orderBy(F.desc("n"), "id").collect()
    by_rank = np.array([r["id"] for r in counts] or [end_id], np.int64)
    rank_of = np.zeros(int(by_rank.max()) + 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    total = sum(r["n"] for r in counts)
    spark.range(1).select(F.lit(by_rank.astype("<u4").tobytes()).alias("id_by_rank")).write.parquet(f"{path}/vocabulary")

    parts = max(partitions(docs), -(-total * 3 // 2 // PART_BYTES))
    shares = [i / parts for i in range(1, parts)]
    bounds = tokens.agg(F.percentile_approx("doc_id", shares, 10 * max(parts, 1000))).first()[0] if shares else []
    cuts = np.array(bounds or [], np.int64)
    shared = spark.sparkContext.broadcast(rank_of)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks_of = shared.value
        for batch in batches:
            data, offsets = K.text_buffers(batch.column("ids"))
            width = np.dtype(ID_TYPE).itemsize
            part = np.searchsorted(cuts, batch.column("doc_id").fill_null(-(2**63)).to_numpy(), side="right").astype(np.int32)
            for a, b in K.slices(data, offsets, 4 * K.BLOCK):
                ids = data[offsets[a] : offsets[b]].view(ID_TYPE)
                n = np.diff(offsets[a : b + 1]) // width
                room = (n + 3) // 4
                padded = np.zeros(4 * int(room.sum()), np.uint32)
                first = 4 * (np.cumsum(room) - room)
                padded[K.ragged(first, n)] = ranks_of[ids]
                control, coded = encode_ranks(padded)
                control_at = np.concatenate([[0], np.cumsum(room)])
                coded_at = np.concatenate([[0], np.cumsum(_DATA_BYTES[control])])[control_at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[a:b]), batch.column("doc_id").slice(a, b - a), pa.array(n), _binary(control, control_at), _binary(coded, coded_at)],
                    names=["part", "doc_id", "n_tokens", "control", "data"],
                )

    coded = tokens.select("doc_id", "ids").mapInArrow(encode, "part int, doc_id long, n_tokens long, control binary, data binary")
    (
        coded.repartitionById(parts, F.col("part"))
        .sortWithinPartitions("part", "doc_id", "n_tokens", "control", "data")
        .withColumn("row", F.monotonically_increasing_id())
        .write.option("compression", "zstd").parquet(f"{path}/rows")
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(part, row, doc_id, n_tokens, ids): ids are little-endian unsigned 32-bit integers."""
    by_rank = np.frombuffer(spark.read.parquet(f"{path}/vocabulary").first()[0], "<u4")
    shared = spark.sparkContext.broadcast(by_rank)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_by_rank = shared.value
        for batch in batches:
            data, data_at = K.text_buffers(batch.column("data"))
            control, control_at = K.text_buffers(batch.column("control"))
            n = batch.column("n_tokens").to_numpy()
            for a, b in K.slices(data, data_at, 4 * K.BLOCK):
                ranks = decode_ranks(control[control_at[a] : control_at[b]], data[data_at[a] : data_at[b]])
                ids = ids_by_rank[ranks[K.ragged(4 * (control_at[a:b] - control_at[a]), n[a:b])]]
                at = np.concatenate([[0], np.cumsum(n[a:b])])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(a, b - a) for c in ("part", "row", "doc_id", "n_tokens")), _binary(ids, 4 * at)],
                    names=["part", "row", "doc_id", "n_tokens", "ids"],
                )

    rows = spark.read.parquet(f"{path}/rows").select("part", "row", "doc_id", "n_tokens", "control", "data")
    return rows.mapInArrow(decode, "part int, row long, doc_id long, n_tokens long, ids binary")


def token_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, offset): ids in the parts before; one row for each part of the files."""
    totals = spark.read.parquet(f"{path}/rows").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of all documents, taken from the files read back."""
    path = scratch_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path)
    found = read_token_files(spark, path).select("part", "row", "doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    inside = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return found.join(token_starts(spark, path), "part").select(
        "doc_id", (F.col("inside") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"
    )
