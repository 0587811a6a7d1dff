"""Vectorised text kernels that run inside Arrow tasks.

Everything here works on one bounded block of texts at a time: a UTF-8 byte
buffer plus document offsets.  Words are maximal runs of bytes other than
0x20 and 0x09-0x0D, which never occur inside a multi-byte character, so the
byte view and the code-point view of a word agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

_PRIME = 0x9E3779B97F4A7C15  # odd, hence invertible modulo 2**64
_MASK = (1 << 64) - 1

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE[_LOWER]

_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, 0..n, grown on demand."""
    if len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        for k, base in enumerate((_PRIME, pow(_PRIME, -1, 1 << 64))):
            table = np.full(size, np.uint64(base & _MASK))
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


def mix64(h: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser; returns a new array."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def text_blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string array into runs of rows of at most ``limit`` bytes (one row at least).

    Yields ``(first_row, end_row, bytes, offsets)``; nulls count as empty.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    large = pa.types.is_large_string(texts.type)
    n = len(texts)
    _, off_buf, data_buf = texts.buffers()
    if n == 0:
        return
    offsets = np.frombuffer(off_buf, dtype=np.int64 if large else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data_buf, dtype=np.uint8) if data_buf is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), n)
        lo, hi = int(offsets[row]), int(offsets[end])
        yield row, end, data[lo:hi], offsets[row : end + 1] - lo
        row = end


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and each document's range among them (CSR)."""
    inside = ~_SPACE[data]
    n = len(data)
    edges = offsets[1:-1]
    edges = edges[edges < n]
    before = np.empty(n, dtype=bool)
    after = np.empty(n, dtype=bool)
    if n:
        before[0] = False
        before[1:] = inside[:-1]
        before[edges] = False
        after[-1] = False
        after[:-1] = inside[1:]
        cut = edges[edges > 0]
        after[cut - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words and the documents' ranges among them.

    Lower-casing concerns A-Z only.
    """
    starts, ends, ranges = word_bounds(data, offsets)
    power, inverse = _power_tables(len(data) + 1)
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * power[: len(data)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * inverse[starts]), ranges


def shingle_hashes(words: np.ndarray, ranges: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word shingles and the documents' ranges among them.

    A document with fewer words, but one at least, has its whole sequence as
    its only shingle; one without words has none.
    """
    n_words = np.diff(ranges)
    counts = np.where(n_words >= width, n_words - width + 1, (n_words > 0).astype(np.int64))
    out = np.concatenate([[0], np.cumsum(counts)])
    total = len(words)
    factors = [np.uint64((_PRIME * (2 * j + 1) ** 3) & _MASK) for j in range(width)]
    rolled = np.zeros(max(total - width + 1, 0), dtype=np.uint64)
    for j, factor in enumerate(factors):
        rolled += words[j : j + len(rolled)] * factor
    rolled = mix64(rolled)
    result = np.empty(int(out[-1]), dtype=np.uint64)
    if len(result):
        pos = np.arange(len(result)) + np.repeat(ranges[:-1] - out[:-1], counts)
        full = np.repeat(n_words >= width, counts)
        result[full] = rolled[pos[full]]
        for d in np.flatnonzero((n_words > 0) & (n_words < width)):
            seq = words[ranges[d] : ranges[d + 1]]
            h = np.uint64(len(seq))
            for w, factor in zip(seq, factors, strict=False):
                h = np.uint64((int(h) * 31 + int(w) * int(factor)) & _MASK)
            result[out[d]] = mix64(np.array([h], dtype=np.uint64))[0] ^ np.uint64(len(seq))
    return result, out


def distinct_runs(values: np.ndarray, ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per document, its sorted distinct values."""
    parts, sizes = [], np.zeros(len(ranges) - 1, dtype=np.int64)
    for d in range(len(sizes)):
        v = np.sort(values[ranges[d] : ranges[d + 1]])
        if len(v) > 1:
            keep = np.empty(len(v), dtype=bool)
            keep[0] = True
            np.not_equal(v[1:], v[:-1], out=keep[1:])
            v = v[keep]
        parts.append(v)
        sizes[d] = len(v)
    flat = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
    return flat, np.concatenate([[0], np.cumsum(sizes)])
