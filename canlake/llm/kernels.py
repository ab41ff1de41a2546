"""Numpy kernels over batches of text, shared by the operators that read every word.

A batch is the byte buffer of an Arrow string column and its row offsets.  Words are
maximal runs of bytes outside ``\\x20 \\x09-\\x0D``; A-Z is lower-cased byte by byte, so
other letters keep their bytes.  A word's 64-bit hash joins two polynomials in random values
per byte, one modulo 2^64 and one modulo the prime 2^31 - 1, and the word's length; both come from prefix
sums, so no Python code runs per word.  (Modulo 2^64 alone, long words of a regular build
collide whatever the base.)

Texts are worked on in blocks of about ``BLOCK`` bytes that end at white space, so the
scratch memory does not grow with the length of a text (a single word longer than a
block is the only exception).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_VALUE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER_VALUE = _BYTE_VALUE[_LOWER]
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_PRIME = np.uint64(2**31 - 1)
_PRIME_VALUE = np.random.default_rng(20250117).integers(1, 2**31 - 1, 256, dtype=np.uint64)
_PRIME_LOWER_VALUE = _PRIME_VALUE[_LOWER]
_PRIME_BASE = 1220703125
_PRIME_INVERSE = pow(_PRIME_BASE, -1, 2**31 - 1)
_powers: dict[int, np.ndarray] = {}
_prime_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept between calls."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = max(n, BLOCK + 4096)
        known = np.ones(size, dtype=np.uint64)
        known[1:] = np.uint64(base)
        np.multiply.accumulate(known, out=known)
        if size <= 4 * BLOCK:
            _powers[base] = known
    return known[:n]


def _prime_powers_of(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^31 - 1, kept between calls."""
    known = _prime_powers.get(base)
    if known is None or len(known) < n:
        size = max(n, BLOCK + 4096)
        known = np.ones(size, dtype=np.uint64)
        done = 1
        while done < size:
            step = min(done, size - done)
            known[done : done + step] = known[:step] * np.uint64(pow(base, done, 2**31 - 1)) % _PRIME
            done += step
        if size <= 4 * BLOCK:
            _prime_powers[base] = known
    return known[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """Hash of ``data[start:end]`` for each span."""
    n = len(data)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((_LOWER_VALUE if lower else _BYTE_VALUE)[data] * _powers_of(_BASE, n), out=prefix[1:])
    first = (prefix[ends] - prefix[starts]) * _powers_of(_BASE_INVERSE, n + 1)[starts]
    terms = (_PRIME_LOWER_VALUE if lower else _PRIME_VALUE)[data] * _prime_powers_of(_PRIME_BASE, n)
    # Terms below 2^32, so that 2^32 of them add up in 64 bits.
    np.cumsum((terms & _PRIME) + (terms >> np.uint64(31)), out=prefix[1:])
    second = (prefix[ends] - prefix[starts]) % _PRIME * _prime_powers_of(_PRIME_INVERSE, n + 1)[starts] % _PRIME
    return mixed(first ^ mixed(second << np.uint64(32) | (ends - starts).astype(np.uint64)))


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n+1 row offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def white(data: np.ndarray, at: int, end: int) -> np.ndarray:
    return _SPACE[data[at:end]]


def blocks(data: np.ndarray, offsets: np.ndarray, size: int = BLOCK, stops: Callable = white) -> Iterator[tuple[int, int]]:
    """Byte ranges of about ``size`` that end at a row's end or just before white space.

    ``stops(data, at, end)`` tells for each of these bytes whether a range may end before it.
    """
    at, n = 0, len(data)
    while at < n:
        end = min(at + size, n)
        if end < n:
            row_end = offsets[np.searchsorted(offsets, end, side="right") - 1]
            if row_end > at:
                end = int(row_end)
            else:
                row_stop = int(offsets[np.searchsorted(offsets, at, side="right")])
                while end < row_stop:
                    near = np.flatnonzero(stops(data, end, min(end + 65536, row_stop)))
                    if len(near):
                        end += int(near[0])
                        break
                    end = min(end + 65536, row_stop)
        yield at, end
        at = end


def word_spans(data: np.ndarray, offsets: np.ndarray, at: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``data[at:end]``, relative to ``at``."""
    inside = ~_SPACE[data[at:end]]
    first = np.ones(end - at, dtype=bool)
    first[1:] = ~inside[:-1]
    edges = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, end)] - at
    first[edges] = True
    starts = np.flatnonzero(inside & first)
    last = np.ones(end - at, dtype=bool)
    last[:-1] = first[1:] | ~inside[1:]
    return starts, np.flatnonzero(inside & last) + 1


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words in order, and the n+1 offsets of each row's words."""
    found, at_bytes = [], []
    for at, end in blocks(data, offsets):
        starts, ends = word_spans(data, offsets, at, end)
        found.append(span_hashes(data[at:end], starts, ends, lower=True))
        at_bytes.append(starts + at)
    if not found:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(found), np.searchsorted(np.concatenate(at_bytes), offsets)


#: Rows of a slice; a row number then takes 12 bits of a sort key.
MOST_ROWS = 4095


def slices(data: np.ndarray, offsets: np.ndarray, size: int = 4 * BLOCK) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``size`` bytes together, at least one and at most ``MOST_ROWS`` rows each."""
    at, rows = 0, len(offsets) - 1
    while at < rows:
        stop = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        stop = min(max(at + 1, stop), at + MOST_ROWS, rows)
        yield at, stop
        at = stop


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of runs of ``width`` words; fewer words count as one run, none as nothing."""
    n = len(words)
    if n == 0:
        return words
    count = max(1, n - width + 1)
    used = min(width, n)
    total = np.zeros(count, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(used):
            total = (total ^ words[i : i + count]) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(2 * i + 1 + 1000 * used)
    return mixed(total)


def sorted_distinct_by_row(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values in ascending order, and the new offsets.

    At most ``MOST_ROWS`` rows; of a value the upper 52 bits count, so that one machine
    word holds row and value and a plain sort does.
    """
    rows = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(offsets))
    keys = (rows << np.uint64(52)) | (values >> np.uint64(12))
    keys.sort()
    fresh = np.ones(len(keys), dtype=bool)
    fresh[1:] = keys[1:] != keys[:-1]
    keys = keys[fresh]
    return keys << np.uint64(12), np.searchsorted(keys >> np.uint64(52), np.arange(len(offsets), dtype=np.uint64))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, .. for each (start, length), one after the other."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)
