"""I-Match fingerprints over randomised lexicon subsets.

The lexicon holds the words whose inverse document frequency, as a share of its greatest
value log N, lies in ``BAND``: neither the words of most documents nor those of hardly
any.  A document keeps its distinct lexicon words, and for each of ``SUBSETS`` random
subsets of the lexicon the words in it are hashed as a set.  One subset changes only
if one of its own words does, so an edited document keeps a share of its hashes.

A subset takes a word with chance 2^-level, where the level is the logarithm of the
document's number of lexicon words, so that it holds about one word of the document
whatever its length; the next level is kept as well, and two documents are compared on a
level that both have.  Likeness is the share of equal hashes among the subsets that are
not empty in both.

Null text counts as empty.  A document without lexicon words gets the hash of all its
words instead (``x``), which is like an equal one only.  Documents follow each other by
doc_id, then by text; equal rows are fingerprinted each for itself; an only document
follows itself.  Frequencies are exact: every word's documents are counted by its hash, first in
each task, then in a shuffle.  The lexicon goes to all tasks with 8 bytes for each of its words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canlake.llm import kernels as K
from canlake.llm.common import partitions, table

BAND = (0.15, 0.8)
SUBSETS = 24
#: Word hashes that a task adds up before it passes them on.
COUNTED = 1 << 20
_SALTS = np.random.default_rng(7).integers(1, 2**63, SUBSETS, dtype=np.uint64)
RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def distinct_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return K.sorted_distinct_by_row(*K.word_hashes(data, offsets))


def word_documents(texts: DataFrame) -> DataFrame:
    """(word, n): the number of rows with each word hash; tasks add up about ``COUNTED`` words before the shuffle."""

    def summed(words: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        found, back = np.unique(np.concatenate(words), return_inverse=True)
        return found, np.bincount(back, np.concatenate(counts), len(found)).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, held = [], [], 0
        for batch in batches:
            data, offsets = K.text_buffers(batch.column(0))
            for a, b in K.slices(data, offsets):
                found, _ = distinct_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                found, n = np.unique(found, return_counts=True)
                words.append(found)
                counts.append(n)
                held += len(found)
                if held > COUNTED:
                    found, n = summed(words, counts)
                    if len(found) > COUNTED // 2:  # mostly different words: they leave
                        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["word", "n"])
                        found, n = found[:0], n[:0]
                    words, counts, held = [found], [n], len(found)
        if held:
            found, n = summed(words, counts)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["word", "n"])

    return texts.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def lexicon(texts: DataFrame, band: tuple[float, float] = BAND) -> np.ndarray:
    """The hashes of the words that belong to the lexicon, in ascending order."""
    n = max(texts.count(), 2)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            idf = np.log(n / np.minimum(batch.column("n").to_numpy(), n)) / np.log(n)
            rows = np.flatnonzero((idf >= band[0]) & (idf <= band[1]))
            words = batch.column("word").take(pa.array(rows)).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array([words.tobytes()], pa.binary())], names=["words"])

    # Eight bytes for each word of the lexicon come to the driver.
    rows = word_documents(texts).mapInArrow(choose, "words binary").toLocalIterator()
    return np.sort(np.frombuffer(b"".join(r["words"] for r in rows), np.uint64))


class Fingerprints:
    """Fingerprints of a batch of texts as arrays: level, hashes (two levels), fallback."""

    def __init__(self, texts: list[str], in_lexicon: np.ndarray):
        data, offsets = K.text_buffers(pa.array(texts, pa.large_string()))
        rows = len(texts)
        self.level = np.zeros(rows, np.int64)
        self.hashes = np.zeros((rows, 2, SUBSETS), np.uint32)
        self.fallback = np.zeros(rows, np.uint64)
        self.known = np.zeros(rows, dtype=bool)
        for a, b in K.slices(data, offsets):
            words, at = distinct_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            row = np.repeat(np.arange(a, b), np.diff(at))
            np.add.at(self.fallback, row, K.mixed(words))
            place = np.searchsorted(in_lexicon, words)
            inside = np.append(in_lexicon, np.uint64(0))[place] == words if len(in_lexicon) else np.zeros(len(words), dtype=bool)
            self._hash_subsets(words[inside], row[inside])

    def _hash_subsets(self, words: np.ndarray, row: np.ndarray) -> None:
        n = np.bincount(row, minlength=len(self.level))
        self.known |= n > 0
        self.level = np.where(n > 0, np.log2(np.maximum(n, 1)).astype(np.int64), self.level)
        mask = (np.uint64(1) << self.level.astype(np.uint64)[row]) - np.uint64(1)
        sums = np.zeros((len(self.level), 2, SUBSETS), np.uint64)
        for s in range(SUBSETS):
            h = K.mixed(words ^ _SALTS[s])
            taken = np.flatnonzero((h & mask) == 0)
            h, at = h[taken], row[taken]
            value = K.mixed(h)
            np.add.at(sums, (at, 0, s), value)
            deeper = (h >> self.level.astype(np.uint64)[at]) & np.uint64(1) == 0
            np.add.at(sums, (at[deeper], 1, s), value[deeper])
        self.hashes |= np.where(sums > 0, np.maximum(sums >> np.uint64(40), np.uint64(1)), np.uint64(0)).astype(np.uint32)

    def strings(self, at: slice) -> list[str]:
        out = []
        wide = self.hashes[at].astype(">u4").view(np.uint8).reshape(-1, 2 * SUBSETS, 4)[:, :, 1:]
        for known, level, raw, rest in zip(self.known[at].tolist(), self.level[at].tolist(), np.ascontiguousarray(wide), self.fallback[at].tolist()):
            out.append(f"{level:02d}:{raw.tobytes().hex()}" if known else f"x:{rest:016x}")
        return out

    def likeness(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Likeness of the rows ``left`` to the rows ``right``, 0 to 1."""
        best = np.zeros(len(left))
        for i in range(2):
            for j in range(2):
                x, y = self.hashes[left, i], self.hashes[right, j]
                filled = ((x > 0) | (y > 0)).sum(axis=1)
                equal = ((x == y) & (x > 0)).sum(axis=1) / np.maximum(filled, 1)
                comparable = self.known[left] & self.known[right] & (self.level[left] + i == self.level[right] + j)
                best = np.where(comparable, np.maximum(best, equal), best)
        both_unknown = ~self.known[left] & ~self.known[right]
        same = (self.fallback[left] == self.fallback[right])
        return np.where(both_unknown, same.astype(float), best)


def in_order_with_next(docs: DataFrame) -> tuple[DataFrame, int]:
    """Documents in parts by doc_id; each part ends with the first documents of the next (``halo``).

    Texts travel compressed.  The cuts are quantiles of doc_id, so a part is bounded by the
    number of documents, and one row for each part comes to the driver.
    """
    ids = docs.select("doc_id")
    parts = partitions(docs)
    shares = [i / parts for i in range(1, parts)]
    bounds = ids.agg(F.percentile_approx("doc_id", shares, 10 * max(parts, 1000))).first()[0] if shares else []
    cuts = np.unique(np.array(bounds or [], np.int64))

    def part_of(doc_ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(cuts, doc_ids, side="right").astype(np.int32)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).fill_null(-(2**63))
            yield pa.RecordBatch.from_arrays([pa.array(part_of(ids.to_numpy())), ids], names=["part", "doc_id"])

    firsts = ids.mapInArrow(label, "part int, doc_id long").groupBy("part").agg(F.min("doc_id").alias("first")).orderBy("part").collect()
    first = np.array([r["first"] for r in firsts], np.int64)
    previous = np.array([firsts[i - 1]["part"] for i in range(len(firsts))], np.int32)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids = batch.column("doc_id").fill_null(-(2**63)).to_numpy()
            packed = pa.array([packer.compress((t or "").encode()) for t in batch.column("text").to_pylist()], pa.binary())
            leads = np.flatnonzero(np.isin(ids, first))
            to = previous[np.searchsorted(first, ids[leads])]
            for rows, part, halo in ((np.arange(len(ids)), part_of(ids), False), (leads, to, True)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part), pa.array(np.full(len(rows), halo)), batch.column("doc_id").take(pa.array(rows)), packed.take(pa.array(rows))],
                    names=["part", "halo", "doc_id", "text"],
                )

    dealt = docs.select("doc_id", "text").mapInArrow(deal, "part int, halo boolean, doc_id long, text binary")
    return dealt.repartitionById(max(parts, 1), F.col("part")).sortWithinPartitions("part", "halo", "doc_id", "text"), parts


def fingerprinted(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """Fingerprints of every document and of its edited text, with their likeness."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon(docs, band))
    ordered, _ = in_order_with_next(docs)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            for halo, doc_id, raw in zip(*(batch.column(c).to_pylist() for c in ("halo", "doc_id", "text"))):
                yield halo, doc_id, unpacker.decompress(raw).decode("utf-8", "replace")

    def result(ids: list, texts: list[str], in_lexicon: np.ndarray) -> pa.RecordBatch:
        """``texts`` has one more entry than ``ids``: the document after the last."""
        n = len(ids)
        edited = [t[: len(t) - len(t) // 4] + after[: len(t) // 4] for t, after in zip(texts, texts[1:])]
        prints = Fingerprints([*texts, *edited], in_lexicon)
        own = np.arange(n)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts[:n]], pa.int64()),
             pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
             pa.array(prints.strings(slice(0, n)), pa.string()), pa.array(prints.strings(slice(n + 1, None)), pa.string()),
             pa.array(prints.likeness(own, own + n + 1)), pa.array(prints.likeness(own, own + 1))],
            names=[c.split()[0] for c in RESULT.split(", ")],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_lexicon, ids, texts, held, ended = shared.value, [], [], 0, False
        for halo, doc_id, text in rows(batches):
            if ended:  # further documents with the first doc_id of the next part
                continue
            texts.append(text)
            held += len(text)
            if halo:
                ended = True
            else:
                ids.append(doc_id)
            if ids and len(texts) > len(ids) and ended:
                yield result(ids, texts, in_lexicon)
            elif len(ids) > 1 and (held > 2 * K.BLOCK or len(ids) > 1000):
                yield result(ids[:-1], texts, in_lexicon)
                ids, texts, held = ids[-1:], texts[-1:], len(text)

    return ordered.mapInArrow(run, RESULT)


def op4_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprinted(table(spark, sf_dir, "documents"))
