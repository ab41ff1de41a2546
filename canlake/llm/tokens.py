"""Token ids of whole texts with a public tokenizer, as a Spark stage.

The library's byte-level BPE cuts a text into pre-tokens before it merges, so a text may
be cut at any place that surely ends a pre-token and its pieces encoded one by one.
Added tokens of the vocabulary (``<|endoftext|>``) get their ids like in the library; no
cut lies inside one.
Every new piece goes through the tokenizers library once and is kept in a table of fixed
size in each Python worker; a repeat copies its ids.  The table only saves time: an
evicted piece is encoded again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from canlake.llm import kernels as K

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
TABLE_BITS = 21
POOL = 1 << 24
#: Ids of the public vocabularies fit into 16 bits; a larger vocabulary is refused.
ID_TYPE = "<u2"

_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True
_ASCII_MARK = np.zeros(256, dtype=bool)  # printable ASCII that is neither a letter nor a space
_ASCII_MARK[0x21:0x7F] = ~_ASCII_LETTER[0x21:0x7F]


def _letters(block: np.ndarray) -> np.ndarray:
    """Bytes that surely belong to letters: A-Z, a-z and U+00C0 to U+00FF but for its two signs."""
    letter = _ASCII_LETTER[block]
    lead = np.flatnonzero(block[:-1] == 0xC3)
    follow = block[lead + 1]
    lead = lead[(follow >= 0x80) & (follow != 0x97) & (follow != 0xB7)]
    letter[lead] = letter[lead + 1] = True
    return letter


def _cuts(block: np.ndarray, letter: np.ndarray) -> np.ndarray:
    """Places where a pre-token surely begins.

    A lone space or line feed between two characters that are not white space begins
    one (a line feed also ends it), and so does a mark or digit after a letter.
    """
    mark = _ASCII_MARK[block]
    solid = letter | mark
    cut = np.zeros(len(block), dtype=bool)
    if len(block) > 2:
        between = solid[:-2] & solid[2:]
        feed = between & (block[1:-1] == 0x0A)
        cut[1:-1] = (between & (block[1:-1] == 0x20)) | feed
        cut[2:] |= feed
    cut[1:] |= mark[1:] & letter[:-1]
    return cut


def _after_word(data: np.ndarray, at: int, end: int) -> np.ndarray:
    """Which bytes of ``data[at:end]`` are ASCII white space after a character that surely is none.

    A pre-token begins there, whatever follows.
    """
    own = np.concatenate([np.zeros(max(3 - at, 0), np.uint8), data[max(at - 3, 0) : end]])
    third, second, last = own[:-3], own[1:-2], own[2:-1]
    wide = (second == 0xC2) | ((third == 0xE2) & ((second == 0x80) | (second == 0x81)))  # U+0085, U+00A0, U+2000 to U+205F
    wide |= (last == 0x80) & (((third == 0xE1) & (second == 0x9A)) | ((third == 0xE3) & (second == 0x80)))  # U+1680, U+3000
    return K.white(data, at, end) & (last > 0x20) & (last != 0x7F) & ~((last >= 0x80) & wide)


class PieceEncoder:
    """Encodes byte batches; keeps the ids of pieces seen before."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(vocabulary)
        added = self.tokenizer.get_added_tokens_decoder().values()
        # Whether a token takes or judges its neighbours, so that no cut may touch it.
        self.added = [(t.content.encode(), t.lstrip or t.rstrip or t.single_word) for t in added if t.content]
        self.merge = self.tokenizer.model.tokenize
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.alphabet = {b: level.pre_tokenize_str(chr(b))[0][0] for b in range(128)}
        # A byte of a longer character: U+00C0 + n is written as the bytes C3 80+n, U+0080 + n as C2 80+n.
        lead = level.pre_tokenize_str(chr(0xC0))[0][0]
        self.alphabet |= {0xC3: lead[0]}
        self.alphabet |= {0x80 + n: level.pre_tokenize_str(chr(0xC0 + n))[0][0][1] for n in range(64)}
        self.forget()

    def forget(self) -> None:
        size = 1 << TABLE_BITS
        self.keys, self.starts, self.lengths = np.zeros(size, np.uint64), np.zeros(size, np.int64), np.zeros(size, np.int32)
        self.pool, self.filled = np.zeros(1 << 16, np.uint32), 0

    def _encode_new(self, block: np.ndarray, starts: np.ndarray, ends: np.ndarray, plain: np.ndarray) -> list[list[int]]:
        raw = block.tobytes()
        plain = plain.tolist()
        spans = list(zip(starts.tolist(), ends.tolist()))
        whole = b"".join(raw[a:b] for (a, b), one in zip(spans, plain) if one).decode("latin-1").translate(self.alphabet)
        merge, encoded, at = self.merge, [], 0
        rest: list[tuple[int, bytes]] = []
        for k, ((a, b), one) in enumerate(zip(spans, plain)):
            if one:  # one pre-token, written with one character for each byte
                encoded.append([t.id for t in merge(whole[at : at + b - a])])
                at += b - a
            else:
                encoded.append([])
                rest.append((k, raw[a:b]))
        if rest:
            texts = [text.decode("utf-8", "replace") for _, text in rest]
            for (k, _), found in zip(rest, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                encoded[k] = found.ids
        return encoded

    def _keep(self, encoded: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.fromiter(map(len, encoded), np.int32, len(encoded))
        total = int(lengths.sum())
        if self.filled + total > len(self.pool):
            grown = np.zeros(max(2 * len(self.pool), self.filled + total), np.uint32)
            grown[: self.filled] = self.pool[: self.filled]
            self.pool = grown
        self.pool[self.filled : self.filled + total] = np.fromiter((i for ids in encoded for i in ids), np.uint32, total)
        starts = self.filled + np.cumsum(lengths, dtype=np.int64) - lengths
        self.filled += total
        return starts, lengths

    def added_spans(self, block: np.ndarray) -> Iterator[tuple[int, int, bool]]:
        """Start, end and neighbourliness of every place that reads like an added token."""
        raw = block.tobytes()
        for content, near in self.added:
            at = raw.find(content)
            while at >= 0:
                yield at, at + len(content), near
                at = raw.find(content, at + 1)

    def stops(self, data: np.ndarray, at: int, end: int) -> np.ndarray:
        """Where a block may end: before white space after a word, but not at an added token that it would change."""
        found = _after_word(data, at, end)
        begin = max(at - max((len(content) for content, _ in self.added), default=0), 0)
        for a, b, near in self.added_spans(data[begin : end + at - begin]):
            a, b = a + begin - at, b + begin - at
            found[max(a + (not near), 0) : max(b + near, 0)] = False
        return found

    def encode(self, data: np.ndarray, offsets: np.ndarray, size: int = K.BLOCK) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows in order, and the n+1 offsets of each row's ids."""
        parts, begins, sizes = [], [], []
        for at, end in K.blocks(data, offsets, size, self.stops):
            block = data[at:end]
            letter = _letters(block)
            cut = _cuts(block, letter)
            for a, b, near in self.added_spans(block):
                cut[a + (not near) : b + near] = False
                letter[a:b] = False  # not for the merges alone
            cut[offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, end)] - at] = True
            cut[0] = True
            first = np.flatnonzero(cut)
            last = np.append(first[1:], end - at)
            if self.filled > POOL:
                self.forget()
            key = K.span_hashes(block, first, last, lower=False)
            slot = (key & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)
            starts, lengths = self.starts[slot], self.lengths[slot]
            miss = np.flatnonzero(self.keys[slot] != key)
            if len(miss):
                new, where, back = np.unique(key[miss], return_index=True, return_inverse=True)
                where = miss[where]
                odd = np.concatenate([[0], np.cumsum(~letter)])
                inner = first[where] + (block[first[where]] == 0x20)
                plain = (inner < last[where]) & (odd[last[where]] == odd[inner])
                new_starts, new_lengths = self._keep(self._encode_new(block, first[where], last[where], plain))
                starts[miss], lengths[miss] = new_starts[back], new_lengths[back]
                at_slot = (new & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)
                _, one = np.unique(at_slot, return_index=True)
                at_slot = at_slot[one]
                self.keys[at_slot], self.starts[at_slot], self.lengths[at_slot] = new[one], new_starts[one], new_lengths[one]
            parts.append(self.pool[K.ragged(starts, lengths)])
            begins.append(first + at)
            sizes.append(lengths)
        if not parts:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes), dtype=np.int64)])
        return np.concatenate(parts), ends[np.searchsorted(np.concatenate(begins), offsets)]


_encoders: dict[str, PieceEncoder] = {}


def require_narrow(greatest: int) -> None:
    if greatest > np.iinfo(ID_TYPE).max:
        raise ValueError(f"ids up to {greatest} do not fit the stored type {ID_TYPE}")


def encoder(vocabulary: str) -> PieceEncoder:
    """One encoder for each Python worker and vocabulary file."""
    if vocabulary not in _encoders:
        made = PieceEncoder(vocabulary)
        require_narrow(made.tokenizer.get_vocab_size(with_added_tokens=True) - 1)
        _encoders[vocabulary] = made
    return _encoders[vocabulary]


def tokenised(docs: DataFrame, keep: list[str], end_id: int, vocabulary: str = VOCABULARY) -> DataFrame:
    """Columns ``keep``, ``n_tokens`` and ``ids`` (binary, of ``ID_TYPE``).

    Null texts count as empty.  ``end_id`` is appended to each document.
    """
    require_narrow(end_id)
    taken = docs.select(*keep, F.col("text").alias("text"))
    schema = StructType([*docs.select(*keep).schema.fields, StructField("n_tokens", LongType()), StructField("ids", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            data, offsets = K.text_buffers(batch.column("text"))
            for a, b in K.slices(data, offsets):
                ids, at = encode.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                closed = np.insert(ids, at[1:], end_id).astype(ID_TYPE)
                ends = at + np.arange(len(at))
                counts = np.diff(ends)
                blobs = pa.Array.from_buffers(
                    pa.binary(), b - a,
                    [None, pa.py_buffer((ends * closed.itemsize).astype(np.int32)), pa.py_buffer(closed)],
                )
                columns = [batch.column(name).slice(a, b - a) for name in keep]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(counts), blobs], names=[*keep, "n_tokens", "ids"])

    return taken.mapInArrow(run, schema)

