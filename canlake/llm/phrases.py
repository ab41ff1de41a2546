"""Collocations of 2 to 4 words, counted in tiles over frequency-ranked ids.

Words.  Every task adds up the words of each language in Counters; the words that occur at
least ``least`` times are ranked by frequency over all languages, and the first ``HEAD``
ranks (a fixed number) go to the tasks as dense ids.  Frequent words beyond them have a
63-bit hash as a negative id, and a bit array of fixed size (``FILTER_BITS``) tells a task
which words may be such; a false hit only costs a count that fails ``least`` later.
All other words end a run: no phrase with one of them can occur ``least`` times.
The texts are written once as runs of ids, in rows of bounded length.

Phrases.  A phrase of k words is its first k-1 words, ranked again by frequency, and its
last word: a pair of ranks.  The matrix of pairs is cut into tiles of ``SIDE`` by ``SIDE``
cells.  A tile with many occurrences at hand is counted by ``numpy.bincount`` in a dense array
addressed directly; the others are kept as sorted (pair, count) lists, and so are pairs whose
parts are not in the head, as tuples of word ids.  Tasks send word ids with counts in compressed blocks by
a hash of the ids, and the blocks of a bucket are merged after one shuffle.  A phrase is only counted if both its phrases of k-1 words are frequent.
So a phrase is always known by its word ids, never by a hash of it; hashes of words are checked
to be distinct, and salted anew if two are not.

Scores, the drop rule and the final ranks are joins and run totals in Spark; the products
use decimals of 38 digits.

Null texts are empty, a null language is ``und``.  Repeated rows count each for itself.
Texts of any length are read a block at a time.  An empty table gives no rows.  Columns
other than text and lang are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from itertools import count as numbers
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canlake.llm import kernels as K
from canlake.llm.common import partitions, running_total, table
from canlake.storage import settle

LEAST = 30
LONGEST = 4
TOP = 2000
CONTAINED_PERCENT = 80
UNDETERMINED = "und"

#: Words, and phrases of each length, with a dense rank; the rest is counted as well, in lists.
HEAD = 1 << 18
FILTER_BITS = 24
SIDE_BITS = 9
#: A tile gets an array once a batch has so many occurrences for it.
DENSE = 1 << 12
MOST_TILES = 24
#: Different words a task holds; list entries it holds; ids in a row of runs; ids worked on at once; rows it gives at once.
HELD_WORDS = 1 << 18
HELD_PAIRS = 1 << 19
ROW_IDS = 1 << 17
SLICE_IDS = 1 << 18
#: Buckets of phrases for each partition of the shuffle; one is merged at a time.
BUCKETS_PER_PARTITION = 4
GIVEN = 1 << 16

BREAK, SKIP = 0, np.iinfo(np.int64).min
_IDS = [f"w{i}" for i in range(1, LONGEST + 1)]
_CLEANED = bytes(
    c + 32 if 0x41 <= c <= 0x5A else 0x0A if c in b".,;:!?\n\x0b\x0c\r" else 0x20 if c == 0x09 else c for c in range(256)
)


def word_lists(text: bytes, size: int = K.BLOCK) -> Iterator[list[bytes]]:
    """Words, ``\\n`` for the end of a piece, and empty strings, in lists from about ``size`` bytes each."""
    cleaned, at = text.translate(_CLEANED), 0
    while at < len(cleaned):
        near = [e for e in (cleaned.find(b" ", at + size), cleaned.find(b"\n", at + size)) if e >= 0]
        end = min(near, default=len(cleaned))
        yield cleaned[at:end].replace(b"\n", b" \n ").split(b" ")
        at = end


def texts_by_language(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang"), F.lit(UNDETERMINED)).alias("lang"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of all words."""

    def rows(held: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, counter in held.items():
            for no_word in (b"", b"\n"):
                counter.pop(no_word, None)
            entries = iter(counter.items())
            while part := list(islice(entries, GIVEN)):
                words = pa.array([word for word, _ in part], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), words, pa.array([n for _, n in part], pa.int64())], names=["lang", "word", "n"])
        held.clear()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                counter = held.setdefault(lang, Counter())
                for words in word_lists(text.as_py()):
                    counter.update(words)
                    if len(counter) > HELD_WORDS or len(held) > 1000:
                        yield from rows(held)
                        counter = held.setdefault(lang, Counter())
            if sum(map(len, held.values())) > HELD_WORDS:
                yield from rows(held)
        yield from rows(held)

    return texts_by_language(docs).mapInArrow(add, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def word_id(lang: str, word: bytes, salt: int) -> int:
    """A negative number for a word of a language."""
    code = lang.encode()
    digest = blake2b(b"%d:" % len(code) + code + word, digest_size=8, key=salt.to_bytes(8, "little")).digest()
    return -1 - (int.from_bytes(digest, "little") >> 1) % (2**63 - 2)


def _mixed_ids(columns: list[np.ndarray], salt: int) -> np.ndarray:
    h = np.full(len(columns[0]), salt, np.uint64)
    for column in columns:
        h = K.mixed((h ^ column.view(np.uint64)) + np.uint64(0x9E3779B97F4A7C15))
    return h


def head_and_filter(frequent: DataFrame, keys: list[str], bits_of, most: int) -> tuple[list, np.ndarray | None]:
    """The rows of greatest ``n``, at most ``most``, on the driver, and a bit array of the others (None if there are none).

    ``frequent`` has ``keys`` and n.  The head ends between two powers of 2^(1/16), so that
    it is found from a histogram of fixed size.  ``bits_of(batch)`` gives a place in the array for each row.
    """
    scaled = F.floor(F.log2("n") * 16).cast("int")
    histogram = sorted(((r["step"], r["rows"]) for r in frequent.groupBy(scaled.alias("step")).agg(F.count("*").alias("rows")).collect()), reverse=True)
    held, lowest = 0, None
    for step, rows in histogram:
        if held + rows > most:
            break
        held, lowest = held + rows, step
    if lowest is None:
        head, rest = [], frequent if histogram else None
    else:
        head = frequent.where(scaled >= lowest).select(*keys, "n").collect()  # at most ``most`` rows
        rest = frequent.where(scaled < lowest) if held < sum(rows for _, rows in histogram) else None
    if rest is None:
        return head, None

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = bits_of(batch) >> np.uint64(64 - FILTER_BITS)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(15)).astype(np.int64)), pa.array((at & np.uint64(32767)).astype(np.int64))], names=["chunk", "place"])

    filter_bits = np.zeros((1 << (FILTER_BITS - 15), 4096), np.uint8)
    chunks = rest.select(*keys).mapInArrow(places, "chunk long, place long").groupBy("chunk").agg(F.bitmap_construct_agg("place").alias("bits"))
    for row in chunks.collect():  # FILTER_BITS bits together
        filter_bits[row["chunk"]] = np.frombuffer(row["bits"], np.uint8)
    return head, filter_bits.reshape(-1)


def _in_filter(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> np.uint64(64 - FILTER_BITS)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


class Words:
    """Ids of words: rank + 1 for the head, a negative hash for words that may be frequent, ``BREAK`` for the others."""

    def __init__(self, frequent: DataFrame, salt: int, most: int):
        def bits_of(batch: pa.RecordBatch) -> np.ndarray:
            return self.hashes([word_id(lang, word.encode(), salt) for lang, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())])

        self.salt = salt
        head, self.bits = head_and_filter(frequent, ["lang", "word"], bits_of, most)
        ordered = sorted(head, key=lambda r: (-r["n"], r["lang"], r["word"]))
        self.ranks: dict[str, dict[bytes, int]] = {}
        for rank, row in enumerate(ordered):
            self.ranks.setdefault(row["lang"], {})[row["word"].encode()] = rank + 1
        self.id_type = np.dtype("<i4") if self.bits is None else np.dtype("<i8")

    @staticmethod
    def hashes(ids: list[int]) -> np.ndarray:
        return _mixed_ids([np.array(ids, np.int64)], 1)

    def of(self, lang: str) -> dict[bytes, int]:
        """A table that finds the id of any word of ``lang``."""
        return _Ids(self, lang)


class _Ids(dict):
    def __init__(self, words: Words, lang: str):
        super().__init__(words.ranks.get(lang, {}))
        self.update({b"": SKIP, b"\n": BREAK})
        self.words, self.lang = words, lang

    def __missing__(self, word: bytes) -> int:
        if self.words.bits is None:
            return BREAK
        found = word_id(self.lang, word, self.words.salt)
        return found if _in_filter(self.words.bits, self.words.hashes([found]))[0] else BREAK


def id_runs(docs: DataFrame, words: Words) -> DataFrame:
    """(ids binary, old int): ids of every text in order, at most about ``ROW_IDS`` in a row, and a break after them.

    A text that takes several rows repeats the last ``old`` ids of a row in the next.  Ids
    are 32 bits wide if all frequent words are in the head, else 64.
    """
    kind = words.id_type
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, dict[bytes, int]] = {}
        for batch in batches:
            blobs, olds = [], []

            def row(ids: np.ndarray, old: int) -> None:
                if len(ids) > max(old, 1):
                    blobs.append(np.append(ids, BREAK).astype(kind).tobytes())
                    olds.append(old)

            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                if lang not in tables:
                    if len(tables) > 1000:
                        tables.clear()
                    tables[lang] = shared.value.of(lang)
                find, held, old = tables[lang].__getitem__, np.zeros(0, np.int64), 0
                for found in word_lists(text.as_py()):
                    ids = np.fromiter(map(find, found), np.int64, len(found))
                    ids = ids[ids != SKIP]
                    ids = np.concatenate([held, ids])
                    repeated = np.zeros(len(ids), dtype=bool)
                    repeated[1:] = (ids[1:] == BREAK) & (ids[:-1] == BREAK)
                    repeated[:old] = False
                    held = ids[~repeated]
                    while len(held) > ROW_IDS:
                        row(held[:ROW_IDS], old)
                        old = LONGEST - 1
                        held = held[ROW_IDS - old :]
                row(held, old)
                if sum(map(len, blobs)) > 8 * K.BLOCK:
                    yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), pa.array(olds, pa.int32())], names=["ids", "old"])
                    blobs, olds = [], []
            yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), pa.array(olds, pa.int32())], names=["ids", "old"])

    return settle(texts_by_language(docs).mapInArrow(encode, "ids binary, old int"), "phrase-ids")


class Phrases:
    """Ranks of the most frequent phrases of k words, and a bit array of the other frequent ones."""

    def __init__(self, frequent: DataFrame, k: int, most: int):
        def bits_of(batch: pa.RecordBatch) -> np.ndarray:
            return _mixed_ids([column.to_numpy() for column in batch.columns], 1)

        head, self.bits = head_and_filter(frequent, _IDS[:k], bits_of, most)
        ordered = sorted(head, key=lambda r: (-r["n"], *r[:k]))
        self.columns = [np.array([r[i] for r in ordered], np.int64) for i in range(k)]
        for self.salt in numbers(2):
            hashes = _mixed_ids(self.columns, self.salt)
            self.order = np.argsort(hashes)
            self.sorted = hashes[self.order]
            if not (self.sorted[1:] == self.sorted[:-1]).any():
                break

    def units(self, columns: list[np.ndarray]) -> np.ndarray:
        """Rank + 1 of phrases of the head, -1 for phrases that may be frequent besides, else 0."""
        found = np.zeros(len(columns[0]), np.int64)
        if len(self.sorted):
            hashes = _mixed_ids(columns, self.salt)
            place = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
            rank = self.order[place]
            equal = self.sorted[place] == hashes
            for mine, asked in zip(self.columns, columns):
                equal &= mine[rank] == asked
            found[equal] = rank[equal] + 1
        if self.bits is not None:
            found[(found == 0) & _in_filter(self.bits, _mixed_ids(columns, 1))] = -1
        return found


def _added_up(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of ``columns`` in ascending order with the sums of their counts."""
    order = np.lexsort(columns[::-1])
    columns, counts = [c[order] for c in columns], counts[order]
    fresh = np.zeros(len(counts), dtype=bool)
    fresh[:1] = True
    for column in columns:
        fresh[1:] |= column[1:] != column[:-1]
    first = np.flatnonzero(fresh)
    return [c[first] for c in columns], np.add.reduceat(counts, first) if len(first) else counts


class SortedCounts:
    """Rows of integers with counts, sorted and added up from time to time."""

    def __init__(self, width: int):
        self.width, self.parts, self.held, self.distinct = width, [], 0, 0

    def add(self, columns: list[np.ndarray], counts: np.ndarray | None = None) -> None:
        if len(columns[0]):
            self.parts.append(_added_up(columns, np.ones(len(columns[0]), np.int64)) if counts is None else (columns, counts))
            self.held += len(columns[0])

    def compact(self, limit: int) -> None:
        """Adds up what is held once it has doubled, from ``limit`` rows on."""
        if self.held > max(limit, 2 * self.distinct):
            self.distinct = len(self.merged()[1])

    def merged(self) -> tuple[list[np.ndarray], np.ndarray]:
        if not self.parts:
            return [np.zeros(0, np.int64)] * self.width, np.zeros(0, np.int64)
        columns = [np.concatenate([part[i] for part, _ in self.parts]) for i in range(self.width)]
        found = _added_up(columns, np.concatenate([n for _, n in self.parts]))
        self.parts, self.held = [found], len(found[1])
        return found

    def taken(self, limit: int) -> tuple[list[np.ndarray], np.ndarray] | None:
        """Everything, if it is more than ``limit`` rows even when added up."""
        if self.held <= 2 * limit:
            return None
        found = self.merged()
        if self.held <= limit:
            return None
        self.parts, self.held = [], 0
        return found


class PairTiles:
    """Counts of pairs of ranks: arrays for crowded tiles, sorted lists for the rest."""

    def __init__(self):
        self.dense: dict[int, np.ndarray] = {}
        self.sparse = SortedCounts(1)

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        tile = (left >> SIDE_BITS) << 32 | (right >> SIDE_BITS)
        order = np.argsort(tile, kind="stable")
        tile, left, right = tile[order], left[order], right[order]
        first = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]])) if len(tile) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(tile))
        listed = np.ones(len(tile), dtype=bool)
        side = (1 << SIDE_BITS) - 1
        known = np.isin(tile[first], np.array(list(self.dense), np.int64))
        for i in np.flatnonzero(known | (last - first >= DENSE)):
            a, b, name = int(first[i]), int(last[i]), int(tile[first[i]])
            if name not in self.dense:
                if len(self.dense) >= MOST_TILES:
                    continue
                self.dense[name] = np.zeros(1 << (2 * SIDE_BITS), np.int64)
            cells = (left[a:b] & side) << SIDE_BITS | (right[a:b] & side)
            if b - a >= DENSE:
                self.dense[name] += np.bincount(cells, minlength=1 << (2 * SIDE_BITS))
            else:
                np.add.at(self.dense[name], cells, 1)
            listed[a:b] = False
        self.sparse.add([left[listed] << 32 | right[listed]])

    def pairs(self, found: tuple[list[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return found[0][0] >> 32, found[0][0] & 0xFFFFFFFF, found[1]

    def dense_pairs(self, many: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The filled cells, about ``many`` at once; the arrays go as they are read."""
        side, parts = (1 << SIDE_BITS) - 1, []
        while self.dense:
            name, counters = self.dense.popitem()
            cells = np.flatnonzero(counters)
            parts.append(((name >> 32 << SIDE_BITS) + (cells >> SIDE_BITS), ((name & 0xFFFFFFFF) << SIDE_BITS) + (cells & side), counters[cells]))
            if sum(len(n) for *_, n in parts) > many or not self.dense:
                yield tuple(np.concatenate(column) for column in zip(*parts))
                parts = []


def _slices(batch: pa.RecordBatch, kind: np.dtype) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The ids of some rows of runs, and whether a phrase that ends there is to be counted."""
    data, offsets = K.text_buffers(batch.column("ids"))
    olds = batch.column("old").to_numpy().astype(np.int64)
    for a, b in K.slices(data, offsets, kind.itemsize * SLICE_IDS):
        ids = np.frombuffer(data[offsets[a] : offsets[b]].tobytes(), kind).astype(np.int64)
        counted = np.ones(len(ids), dtype=bool)
        counted[K.ragged((offsets[a:b] - offsets[a]) // kind.itemsize, olds[a:b])] = False
        yield ids, counted


def blocks_of(columns: list[np.ndarray], n: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Rows of ids with their counts as one compressed block for each bucket of phrases."""
    bucket = (_mixed_ids(columns, 3) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    table, bucket = np.stack([*columns, n])[:, order], bucket[order]
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    packer = zstandard.ZstdCompressor(level=1)
    blocks = [packer.compress(table[:, a:b].tobytes()) for a, b in zip(first, np.append(first[1:], len(bucket)))]
    return pa.RecordBatch.from_arrays([pa.array(bucket[first]), pa.array(blocks, pa.binary())], names=["bucket", "block"])


def phrase_counts(runs: DataFrame, k: int, shorter: Phrases | None, kind: np.dtype, least: int = 1) -> DataFrame:
    """(w1, .., wk, n) of the phrases of k words that occur ``least`` times.

    Only phrases whose phrases of k-1 words may be frequent are counted; ``kind`` is the type of ids in ``runs``.
    Tasks send their counts as sorted blocks, a few for each partition of the shuffle, and
    the blocks of a bucket are merged one bucket at a time.
    """
    shared = runs.sparkSession.sparkContext.broadcast(shorter)
    buckets = BUCKETS_PER_PARTITION * partitions(runs)

    def ids_of(left: np.ndarray, right: np.ndarray, n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        before = [left + 1] if k == 2 else [column[left] for column in shared.value.columns]
        return [*before, right + 1], n

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles, tuples = PairTiles(), SortedCounts(k)
        for batch in batches:
            for ids, counted in _slices(batch, kind):
                units, n = ids, len(ids) - k + 1
                if k > 2:
                    alive = ids != BREAK
                    whole = np.logical_and.reduce([alive[j : n + 1 + j] for j in range(k - 1)])
                    at = np.flatnonzero(whole)
                    units = np.zeros(n + 1, np.int64)
                    units[at] = shared.value.units([ids[at + j] for j in range(k - 1)])
                at = np.flatnonzero((units[:n] != 0) & (units[1 : n + 1] != 0) & counted[k - 1 :])
                ranked = (units[at] > 0) & (ids[at + k - 1] > 0)
                tiles.add(units[at[ranked]] - 1, ids[at[ranked] + k - 1] - 1)
                tuples.add([ids[at[~ranked] + j] for j in range(k)])
                if (found := tiles.sparse.taken(HELD_PAIRS)) is not None:
                    yield blocks_of(*ids_of(*tiles.pairs(found)), buckets)
                if (found := tuples.taken(HELD_PAIRS)) is not None:
                    yield blocks_of(*found, buckets)
        yield blocks_of(*ids_of(*tiles.pairs(tiles.sparse.merged())), buckets)
        yield blocks_of(*tuples.merged(), buckets)
        for found in tiles.dense_pairs(HELD_PAIRS):
            yield blocks_of(*ids_of(*found), buckets)
        del tiles, tuples
        pa.default_memory_pool().release_unused()  # this worker goes on to other tasks

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker, current, held = zstandard.ZstdDecompressor(), None, SortedCounts(k)

        def frequent() -> Iterator[pa.RecordBatch]:
            columns, n = held.merged()
            rows = np.flatnonzero(n >= least)
            yield pa.RecordBatch.from_arrays([pa.array(c[rows]) for c in (*columns, n)], names=[*_IDS[:k], "n"])

        for batch in batches:
            for bucket, block in zip(batch.column("bucket").to_pylist(), batch.column("block")):
                if bucket != current:
                    yield from frequent()
                    current, held = bucket, SortedCounts(k)
                table = np.frombuffer(unpacker.decompress(block.as_py()), np.int64).reshape(k + 1, -1)
                held.add(list(table[:k]), table[k])
                held.compact(HELD_PAIRS)
        yield from frequent()

    sent = runs.mapInArrow(add, "bucket long, block binary").repartition(partitions(runs), "bucket").sortWithinPartitions("bucket")
    return sent.mapInArrow(merge, ", ".join(f"{name} long" for name in [*_IDS[:k], "n"]))


def with_ids(words: DataFrame, table_of_ids: Words) -> DataFrame:
    """Adds ``id`` to (lang, word, n)."""
    shared = words.sparkSession.sparkContext.broadcast(table_of_ids)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, dict[bytes, int]] = {}
        for batch in batches:
            if len(tables) > 1000:
                tables.clear()
            found = []
            for lang, word in zip(batch.column("lang").to_pylist(), batch.column("word").to_pylist()):
                if lang not in tables:
                    tables[lang] = shared.value.of(lang)
                found.append(tables[lang][word.encode()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=["lang", "word", "n", "id"])

    return words.select("lang", "word", "n").mapInArrow(add, "lang string, word string, n long, id long")


def distinct_ids(counted: DataFrame, frequent: DataFrame, most: int) -> Words:
    """Ids under which no two words are one; the hashes are salted anew until that is so."""
    for salt in numbers():
        words = Words(frequent, salt, most)
        if words.bits is None or with_ids(counted, words).where("id < 0").groupBy("id").count().where("count > 1").isEmpty():
            return words


def _padded(names: list[str]) -> list:
    return [F.col(name) for name in names] + [F.lit(0).cast("long")] * (LONGEST - len(names))


def _wide(column: Column) -> Column:
    return column.cast("decimal(20,0)")


def scored(words: DataFrame, by_length: dict[int, DataFrame], contained_percent: int) -> DataFrame:
    """(w1..w4, k, a, l, r, score) of the candidates that no longer one takes in."""
    candidates = None
    for k, frequent in by_length.items():
        rows = frequent.select(*(c.alias(name) for c, name in zip(_padded(_IDS[:k]), _IDS)), F.lit(k).alias("k"), F.col("n").alias("a"))
        candidates = rows if candidates is None else candidates.union(rows)
    first = [c.alias(f"p{i}") for i, c in enumerate(_padded(["id"]), 1)]
    parts = words.select(*first, F.col("n").alias("f")).union(candidates.select(*_IDS, "a"))

    def spans(least: int, shorter_only: bool):
        """For each k, the structs (cut, tail, p1..p4) of the parts of a phrase."""
        out = F.array().cast(f"array<struct<cut:int,tail:boolean,{','.join(f'p{i}:bigint' for i in range(1, LONGEST + 1))}>>")
        for k in by_length:
            found = []
            for a in range(k):
                for b in range(a + least, k + 1):
                    if b - a == k or (not shorter_only and a > 0 and b < k):
                        continue
                    ids = [c.alias(f"p{i}") for i, c in enumerate(_padded(_IDS[a:b]), 1)]
                    found.append(F.struct(F.lit(b if a == 0 else a).alias("cut"), F.lit(a > 0).alias("tail"), *ids))
            if found:
                out = F.when(F.col("k") == k, F.array(*found)).otherwise(out)
        return out

    part_ids = [f"p{i}" for i in range(1, LONGEST + 1)]
    cuts = candidates.select(*_IDS, "k", "a", F.inline(spans(1, False))).join(parts, part_ids)
    cuts = cuts.groupBy(*_IDS, "k", "a", "cut").agg(F.max(F.when(~F.col("tail"), F.col("f"))).alias("l"), F.max(F.when(F.col("tail"), F.col("f"))).alias("r"))
    score = F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    lowest = cuts.groupBy(*_IDS, "k", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best"))
    around = candidates.select("a", F.inline(spans(2, True))).groupBy(*part_ids).agg(F.max("a").alias("longer"))
    around = around.select(*(F.col(p).alias(w) for p, w in zip(part_ids, _IDS)), "longer")
    taken_in = _wide(F.col("longer")) * 100 >= _wide(F.col("a")) * contained_percent
    kept = lowest.join(around, _IDS, "left").where(F.col("longer").isNull() | ~taken_in)
    return kept.select(*_IDS, "k", "a", "best.l", "best.r", "best.score")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, contained_percent: int = CONTAINED_PERCENT, head: int = HEAD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases of 2 to 4 words."""
    counted = settle(word_counts(docs), "phrase-words")
    frequent_words = counted.where(F.col("n") >= least)
    words = distinct_ids(counted, frequent_words, head)
    named = settle(with_ids(frequent_words, words), "phrase-ids-of-words")
    runs = id_runs(docs, words)
    by_length: dict[int, DataFrame] = {}
    shorter = None
    for k in range(2, LONGEST + 1):
        by_length[k] = settle(phrase_counts(runs, k, shorter, words.id_type, least), f"phrases-{k}")
        if k < LONGEST:
            shorter = Phrases(by_length[k], k, head)
    found = settle(scored(named, by_length, contained_percent), "phrases-scored")
    each = found.select(*_IDS, F.posexplode(F.array(*_IDS)).alias("pos", "id")).where("id <> 0").join(named.select("id", "lang", "word"), "id")
    texts = each.groupBy(*_IDS).agg(
        F.min("lang").alias("lang"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("phrase"),
    )
    sizes = counted.groupBy("lang").agg(F.sum("n").alias("all_words"))
    told = found.join(texts, _IDS).select("lang", "phrase", "a", "l", "r", "score", (-F.col("score")).alias("low"), (-F.col("a")).alias("rarer"), F.lit(1).cast("long").alias("one"))
    placed = running_total(settle(told, "phrases-told"), ["lang"], ["low", "rarer", "phrase"], "one", "place", "phrases").where(F.col("place") < top)
    return placed.join(settle(sizes, "phrases-sizes"), "lang").select("lang", (F.col("place") + 1).alias("rank"), "phrase", "a", "l", "r", F.col("all_words").alias("n"), "score")


def op13_phrase_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of all documents' collocations."""
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang,
         regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces
  FROM documents
), pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM (SELECT lang, unnest(pieces) AS piece FROM texts)
), starts AS (
  SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM pieces
), grams AS (
  SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase
  FROM starts, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(words)
), freq AS (
  SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING k = 1 OR count(*) >= 30
), sizes AS (
  SELECT lang, sum(f)::BIGINT AS n FROM freq WHERE k = 1 GROUP BY lang
), candidates AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS words FROM freq WHERE k > 1
), cuts AS (
  SELECT c.lang, c.phrase, c.a, cut, l.f AS l, r.f AS r, ((2000000::HUGEINT * c.a) // (l.f + r.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates) c
  JOIN freq l ON l.lang = c.lang AND l.phrase = array_to_string(c.words[1:cut], ' ')
  JOIN freq r ON r.lang = c.lang AND r.phrase = array_to_string(c.words[cut + 1:], ' ')
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inner_phrases AS (
  SELECT lang, array_to_string(words[s.a:s.b], ' ') AS phrase, max(c.a) AS longer
  FROM candidates c, (SELECT a, b FROM (SELECT unnest(range(1, 5)) AS a), (SELECT unnest(range(1, 5)) AS b) WHERE b > a) s
  WHERE s.b <= c.k AND s.b - s.a + 1 < c.k GROUP BY ALL
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM lowest JOIN sizes USING (lang) LEFT JOIN inner_phrases USING (lang, phrase)
WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a
QUALIFY rank <= 2000
"""
