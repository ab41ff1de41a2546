"""Target-distribution importance resampling over hashed word n-grams.

A 256-byte table lower-cases A-Z and blanks every ASCII byte that is neither a letter nor
a digit, ``bytes.split`` yields the words, and a word's crc32 seeds the crc32 of the next
blank and word, so that every run of 1 to ``width`` words gets the crc32 of its joined
text without being joined.  Counters add the hashes up in each task; a hash leaves as its
bucket, so a task emits and the driver receives at most ``buckets`` numbers for each table,
whatever its size.  A bucket's gain is the logarithm of its smoothed share in the target
over its share in the documents; a document's weight is the mean gain of its features.

Drawing without replacement by weight is a top-k of weight plus Gumbel noise (from sha256
of seed and doc_id, so reruns agree).  Ranks come from a range partitioning with run
totals, never from one sorted partition.

Null and empty texts have no features: n_features and weight are 0.  A document of fewer
than ``least_words`` words has a score but is never drawn.  Ties go to the smaller doc_id
(null first, hashed as an empty string), rows with the same doc_id each take part.  Texts
of any length are split a block at a time.  An empty table of documents gives no rows, an
empty target counts nothing in any bucket.  Further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canlake.llm import kernels as K
from canlake.llm.common import free_name, running_total, table
from canlake.storage import settle

WIDTH = 1
BUCKETS = 10_000
PERCENT = 10
LEAST_WORDS = 20
SEED = 2024
#: Different hashes that a task counts before it folds them into buckets.
HELD = 1 << 18

_BLANKED = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def word_lists(text: bytes, size: int = K.BLOCK) -> Iterator[list[bytes]]:
    """The words of a text in order, in lists from about ``size`` bytes each."""
    blanked, at = text.translate(_BLANKED), 0
    while at < len(blanked):
        end = blanked.find(b" ", at + size)
        end = end if end >= 0 else len(blanked)
        yield blanked[at:end].split()
        at = end


def feature_hashes(text: bytes, width: int, size: int = K.BLOCK) -> Iterator[list[int]]:
    """crc32 of every run of 1 to ``width`` words; the first list of each ``width`` lists holds the single words."""
    carried: list[bytes] = []
    for words in word_lists(text, size):
        old, words = len(carried), carried + words
        after = [b" " + w for w in words] if width > 1 else []
        seeds = list(map(crc32, words))
        yield seeds[old:]
        for length in range(2, width + 1):
            seeds = list(map(crc32, after[length - 1 :], seeds))
            yield seeds[max(old - length + 1, 0) :]  # runs that end in this list's own words
        carried = words[1 - width :] if width > 1 else []


def raw_texts(column: pa.Array) -> Iterator[bytes]:
    """Each text of a column as bytes; null counts as empty."""
    data, offsets = K.text_buffers(column)
    whole = memoryview(data) if len(data) else b""
    for a, b in zip(offsets.tolist(), offsets[1:].tolist()):
        yield bytes(whole[a:b])


def bucket_counts(texts: DataFrame, width: int = WIDTH, buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences of the features of all rows of ``texts`` (text) in each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, held = np.zeros(buckets, np.int64), Counter()

        def fold() -> None:
            at = np.fromiter(held.keys(), np.int64, len(held)) % buckets
            np.add.at(sums, at, np.fromiter(held.values(), np.int64, len(held)))
            held.clear()

        for batch in batches:
            for text in raw_texts(batch.column(0)):
                for hashes in feature_hashes(text, width):
                    held.update(hashes)
                    if len(held) > HELD:
                        fold()
        fold()
        filled = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(filled), pa.array(sums[filled])], names=["bucket", "n"])

    found = texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.zeros(buckets, np.int64)
    for row in found.collect():  # one row for each bucket
        total[row["bucket"]] = row["n"]
    return total


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(share in the target / share in the documents)) with one added to every count."""
    wide = float(len(raw))
    all_raw, all_target = float(raw.sum()) + wide, float(target.sum()) + wide
    found = (math.floor(1000 * math.log((t + 1.0) * all_raw / ((s + 1.0) * all_target))) for s, t in zip(raw.tolist(), target.tolist()))
    return np.fromiter(found, np.int64, len(raw))


def weighted(docs: DataFrame, gains: np.ndarray, keep: list[str], width: int = WIDTH) -> DataFrame:
    """Columns ``keep``, n_words, n_features and weight of every row.  ``gains`` has one number for each bucket."""
    schema = docs.select(*keep).schema.add("n_words", "long").add("n_features", "long").add("weight", "long")
    text = free_name(keep, "text")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = len(gains)
        for batch in batches:
            rows = []
            for raw in raw_texts(batch.column(text)):
                words = features = total = 0
                for i, hashes in enumerate(feature_hashes(raw, width)):
                    words += len(hashes) if i % width == 0 else 0
                    features += len(hashes)
                    total += int(gains[np.array(hashes, np.int64) % buckets].sum())
                rows.append((words, features, total // features if features else 0))
            added = np.array(rows, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(name) for name in keep), *(pa.array(np.ascontiguousarray(added[:, i])) for i in range(3))],
                names=[*keep, "n_words", "n_features", "weight"],
            )

    return docs.select(*keep, F.col("text").alias(text)).mapInArrow(weigh, schema)


def noise(seed: int = SEED):
    """Gumbel noise in thousandths from sha256 of ``seed:doc_id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resampled(docs: DataFrame, target: DataFrame, width: int = WIDTH, buckets: int = BUCKETS, percent: int = PERCENT,
              least_words: int = LEAST_WORDS, seed: int = SEED, key: str | None = None) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null where not drawn) of every document.

    ``key`` names a unique long column of ``docs`` that comes along as ``row_key``.
    """
    gains = bucket_gains(bucket_counts(docs, width, buckets), bucket_counts(target, width, buckets))
    row_key = F.col(key) if key else F.monotonically_increasing_id()
    named = docs.select("doc_id", "text", row_key.alias("row_key"))
    scored = weighted(named, gains, ["doc_id", "row_key"], width).withColumn("score", F.col("weight") + noise(seed))
    may = F.col("n_words") >= least_words
    scored = settle(scored.withColumn("late", ~may).withColumn("low", -F.col("score")).withColumn("one", F.lit(1).cast("long")), "resampling-scores")
    drawn = scored.where(may).count() * percent // 100
    placed = running_total(scored, [], ["late", "low", "doc_id", "row_key"], "one", "place", "resampling")
    rank = F.when(may & (F.col("place") < drawn), F.col("place") + 1)
    return placed.select("row_key", "doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank"))


def resampled_documents(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn documents themselves, with all their columns."""
    key = free_name(docs.columns, "row_key")
    stored = settle(docs.withColumn(key, F.monotonically_increasing_id()), "resampling-documents")
    drawn = resampled(stored, target, key=key, **options).where("rank is not null").select(F.col("row_key").alias(key))
    return stored.join(drawn, key, "left_semi").select(*docs.columns)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_features, weight, score, rank of all documents; the target is all of ``benchmark``."""
    found = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


#: crc32 of the distinct words from a table of 256 entries, which the same SQL makes.
OP11_SQL = r"""
WITH crc_table AS (
  SELECT list(v ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i::BIGINT) AS v
    FROM (SELECT unnest(range(256)) AS i))
), lists AS (
  SELECT 'd' AS part, row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
  UNION ALL
  SELECT 'b', row_number() OVER (), NULL,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
  FROM benchmark
), counted AS (
  SELECT part, r, word, count(*) AS n FROM (SELECT part, r, unnest(words) AS word FROM lists) GROUP BY ALL
), hashed AS (
  SELECT word, xor(4294967295, list_reduce(
           list_transform(range(1, strlen(word) + 1), lambda i: ('0x' || substr(hex(word), (2 * i - 1)::INT, 2))::BIGINT),
           lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295)) % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM counted), crc_table
), sums AS (
  SELECT bucket, coalesce(sum(n) FILTER (part = 'd'), 0) AS s, coalesce(sum(n) FILTER (part = 'b'), 0) AS t
  FROM counted JOIN hashed USING (word) GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM sums) + 10000)::DOUBLE
                                 / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM sums) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM sums
), totals AS (
  SELECT r, sum(n * gain)::BIGINT AS total FROM counted JOIN hashed USING (word) JOIN gains USING (bucket) WHERE part = 'd' GROUP BY r
), scored AS (
  SELECT r, doc_id, len(words)::BIGINT AS n_features,
         CASE WHEN len(words) = 0 THEN 0 ELSE (total - ((total % len(words)) + len(words)) % len(words)) // len(words) END AS weight,
         floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS noise
  FROM lists LEFT JOIN totals USING (r) WHERE part = 'd'
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + noise DESC, doc_id) AS place,
         count(*) FILTER (n_features >= 20) OVER () AS eligible
  FROM scored
)
SELECT doc_id, n_features, weight::BIGINT AS weight, (weight + noise)::BIGINT AS score,
       CASE WHEN n_features >= 20 AND place <= eligible * 10 // 100 THEN place END AS rank
FROM placed
"""
