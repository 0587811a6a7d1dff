"""Byte-level BPE on whole columns, by a pair occurrence index.

A task gathers the distinct pre-tokens that it has not met yet, lays their
symbols out in one array and maps every adjacent pair that has a merge to all
its positions.  Active ranks are applied in ascending order: all occurrences
of a rank are merged at once, and the pairs that arise at their borders join
the lists of their own ranks.  A pair's rank is always above the ranks that
made its parts, so no list grows once its rank has been applied.

Texts are then strings of pre-token numbers, so ids, pieces and decoded bytes
are array gathers.  The merge file is the public one whose path is given; its
ids must ascend with the merges, which is checked.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import sys
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from . import textkernels as tk
from .common import map_arrow, tokenizer_path

CHUNK_BYTES = 12 << 20
CACHE_WORDS = 600_000

# The alphabet of byte-level vocabularies: printable bytes stand for themselves,
# the others for code points from 256 on.  Fixed by the file format.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
# Code points with the property White_Space. Fixed by Unicode.
_WHITE = [0x20, *range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Suffixes that split off after an apostrophe. Fixed by the pre-token pattern.
_SUFFIXES = ["s", "t", "re", "ve", "m", "ll", "d"]

_OTHER, _LETTER, _NUMBER, _BLANK = 0, 1, 2, 3
_classes: list[np.ndarray] = []


def _class_table() -> np.ndarray:
    if not _classes:
        kinds = bytearray(sys.maxunicode + 1)
        for c in range(sys.maxunicode + 1):
            k = unicodedata.category(chr(c))[0]
            if k == "L":
                kinds[c] = _LETTER
            elif k == "N":
                kinds[c] = _NUMBER
        for c in _WHITE:
            kinds[c] = _BLANK
        _classes.append(np.frombuffer(bytes(kinds), dtype=np.uint8))
    return _classes[0]


def pretoken_starts(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Byte positions where a pre-token starts; ``edges`` are forced (text starts).

    The pattern: an apostrophe suffix, else an optional space with a run of
    letters, of numbers or of other signs, else blanks, of which the last one
    is left out where something follows.
    """
    n = len(data)
    if not n:
        return np.zeros(0, dtype=np.int64)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    m = len(points)
    kind = _class_table()[points]
    first = np.zeros(m + 1, dtype=bool)
    first[np.searchsorted(lead, edges[edges < n])] = True
    first[m] = True
    change = first.copy()
    change[1:m] |= kind[1:] != kind[:-1]
    start = change[:m].copy()
    # the last of a run of blanks belongs to what follows it in the same text
    blank_end = np.flatnonzero((kind[:-1] == _BLANK) & (kind[1:] != _BLANK) & ~first[1:m]) if m > 1 else np.zeros(0, np.int64)
    start[blank_end] = True
    spaced = points[blank_end] == 0x20
    start[blank_end[spaced] + 1] = False
    # apostrophe suffixes, where a pre-token starts with the apostrophe
    for i in np.flatnonzero((points == 0x27) & start):
        tail = "".join(map(chr, points[i + 1 : i + 3]))
        for suffix in _SUFFIXES:
            end = i + 1 + len(suffix)
            if tail.startswith(suffix) and not first[i + 1 : end].any():
                start[i + 1 : end] = False
                if end < m:
                    start[end] = start[end] or change[end] or kind[end] == kind[end - 1]
                break
    return lead[start]


class PairIndexBPE:
    """A byte-level BPE vocabulary with its merges, and a cache of encoded pre-tokens."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        vocab = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], dtype=np.uint32)
        right = np.array([vocab[b] for _, b in merges], dtype=np.uint32)
        self.made = np.array([vocab[a + b] for a, b in merges], dtype=np.int32)
        if np.any(np.diff(self.made) <= 0) or max(vocab.values()) > 0xFFFF:
            raise ValueError("the ids of this vocabulary do not ascend with its merges")
        self.left, self.right = left.astype(np.int32), right.astype(np.int32)
        codes = (left << np.uint32(16)) | right
        order = np.argsort(codes)
        self._codes, self._ranks = codes[order], order.astype(np.int32)
        letters = {b: chr(b) for b in _PRINTABLE}
        extra = 256
        for b in range(256):
            if b not in letters:
                letters[b] = chr(extra)
                extra += 1
        back = {c: b for b, c in letters.items()}
        self.byte_ids = np.array([vocab[letters[b]] for b in range(256)], dtype=np.int32)
        special = [(t["content"], t["id"]) for t in spec.get("added_tokens", [])]
        strings = sorted([*vocab.items(), *special], key=lambda x: x[1])
        size = strings[-1][1] + 1
        pieces = [b""] * size
        for token, i in strings:
            pieces[i] = bytes(back[c] for c in token)
        self.token_bytes = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self.token_ranges = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        self.special = [(c.encode(), i) for c, i in special]
        digits = np.zeros((size, 6), dtype=np.uint8)
        for i in range(size):
            s = f"{i},".encode()
            digits[i, : len(s)] = np.frombuffer(s, dtype=np.uint8)
        self.digits = digits
        self.forget()

    def forget(self) -> None:
        """Empty the cache; row 0 and up hold the special tokens."""
        self._rows: dict[int, int] = {}
        self._pool = [np.array([i], dtype=np.uint16) for _, i in self.special]
        self._starts = np.arange(len(self.special), dtype=np.int64)
        self._sizes = np.ones(len(self.special), dtype=np.int64)
        self._flat = np.array([i for _, i in self.special], dtype=np.uint16)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs, -1 without one; a negative symbol has none."""
        code = (a.astype(np.uint32) << np.uint32(16)) | (b.astype(np.uint32) & np.uint32(0xFFFF))
        at = np.minimum(np.searchsorted(self._codes, code), len(self._codes) - 1)
        return np.where((self._codes[at] == code) & (a >= 0) & (b >= 0), self._ranks[at], -1)

    def encode_words(self, data: np.ndarray, ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words given as bytes with CSR ranges, and the ids' ranges."""
        n_words = len(ranges) - 1
        # one slot before each word and one at the end hold -1, so that pairs never cross words
        lengths = np.diff(ranges)
        place = np.arange(len(data)) + np.repeat(np.arange(1, n_words + 1), lengths)
        size = len(data) + n_words + 1
        symbol = np.full(size, -1, dtype=np.int32)
        symbol[place] = self.byte_ids[data]
        after = np.arange(1, size + 1, dtype=np.int32)
        before = np.arange(-1, size - 1, dtype=np.int32)
        after[-1] = size - 1
        before[0] = 0
        lists: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enlist(ranks: np.ndarray, positions: np.ndarray) -> None:
            real = ranks >= 0
            ranks, positions = ranks[real], positions[real]
            if not len(ranks):
                return
            order = np.argsort(ranks, kind="stable")
            ranks, positions = ranks[order], positions[order]
            cut = np.flatnonzero(np.concatenate([[True], ranks[1:] != ranks[:-1]]))
            for r, lo, hi in zip(ranks[cut].tolist(), cut.tolist(), [*cut[1:].tolist(), len(ranks)], strict=True):
                if r in lists:
                    lists[r].append(positions[lo:hi])
                else:
                    lists[r] = [positions[lo:hi]]
                    heapq.heappush(active, r)

        at = place.astype(np.int32)
        enlist(self._rank(symbol[at], symbol[after[at]]), at)
        while active:
            r = heapq.heappop(active)
            found = lists.pop(r)
            at = np.concatenate(found) if len(found) > 1 else found[0]
            a, b = self.left[r], self.right[r]
            at = at[(symbol[at] == a) & (symbol[after[at]] == b)]
            if len(found) > 1 or a == b:
                at = np.unique(at)
            if a == b and len(at) > 1:
                # in a run of equal symbols every second occurrence counts
                joined = np.concatenate([[False], after[at[:-1]] == at[1:]])
                index = np.arange(len(at))
                run = np.maximum.accumulate(np.where(joined, 0, index))
                at = at[(index - run) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            symbol[gone] = -2
            symbol[at] = self.made[r]
            following = after[gone]
            after[at] = following
            before[following] = at
            preceding = before[at]
            new = symbol[at]
            ranks = np.concatenate([self._rank(symbol[preceding], new), self._rank(new, symbol[following])])
            enlist(ranks, np.concatenate([preceding, at]))
        kept = np.flatnonzero(symbol[place] >= 0)
        word = np.repeat(np.arange(n_words), lengths)[kept]
        counts = np.bincount(word, minlength=n_words)
        return symbol[place[kept]].astype(np.uint16), np.concatenate([[0], np.cumsum(counts)])

    def _segments(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """Forced starts: texts, and both ends of special tokens."""
        raw, cuts = data.tobytes(), []
        for row, (mark, _) in enumerate(self.special):
            at = raw.find(mark)
            while at >= 0:
                end = at + len(mark)
                if np.searchsorted(offsets, at, side="right") == np.searchsorted(offsets, end - 1, side="right"):
                    cuts.append((at, end, row))
                at = raw.find(mark, end)
        edges = np.unique(np.concatenate([offsets, [e for s, t, _ in cuts for e in (s, t)]])).astype(np.int64) if cuts else np.unique(offsets)
        return edges, cuts

    def encode_texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts given as bytes with CSR offsets, and the ids' ranges."""
        numbers, ranges = [], [np.zeros(1, dtype=np.int64)]
        pending: dict[int, tuple[int, bytes]] = {}
        if len(self._rows) > CACHE_WORDS:
            self.forget()
        base, count = len(self._starts), 0
        for lo, hi, part, local in _blocks(data, offsets):
            edges, cuts = self._segments(part, local)
            starts = pretoken_starts(part, edges)
            for s, t, _ in cuts:
                starts = starts[(starts <= s) | (starts >= t)]
            ends = np.append(starts[1:], len(part))
            power, inverse = tk._power_tables(len(part) + 1)
            sums = np.empty(len(part) + 1, dtype=np.uint64)
            sums[0] = 0
            np.cumsum(tk._BYTE[part] * power[: len(part)], out=sums[1:])
            hashes = tk.mix64((sums[ends] - sums[starts]) * inverse[starts])
            distinct, example, index = np.unique(hashes, return_index=True, return_inverse=True)
            rows = np.empty(len(distinct), dtype=np.int64)
            get = self._rows.get
            for i, h in enumerate(distinct.tolist()):
                row = get(h)
                if row is None:
                    row = base + count
                    self._rows[h] = row
                    e = example[i]
                    pending[row] = part[starts[e] : ends[e]]
                    count += 1
                rows[i] = row
            words = rows[index]
            if cuts:
                at = {s: row for s, _, row in cuts}
                for i in np.flatnonzero(np.isin(starts, list(at))):
                    words[i] = at[int(starts[i])]
            numbers.append(words)
            ranges.append(np.searchsorted(starts, local[1:]) + ranges[-1][-1])
        if pending:
            new = list(pending.values())
            sizes = np.array([len(w) for w in new])
            ids, spans = self.encode_words(np.concatenate(new), np.concatenate([[0], np.cumsum(sizes)]))
            self._starts = np.concatenate([self._starts, spans[:-1] + len(self._flat)])
            self._sizes = np.concatenate([self._sizes, np.diff(spans)])
            self._flat = np.concatenate([self._flat, ids])
        words = np.concatenate(numbers) if numbers else np.zeros(0, dtype=np.int64)
        bounds = np.concatenate(ranges)
        sizes = self._sizes[words]
        ids = np.empty(int(sizes.sum()), dtype=np.uint16)
        total = np.concatenate([[0], np.cumsum(sizes)])
        step = 1 << 19
        for lo in range(0, len(words), step):
            hi = min(lo + step, len(words))
            span = sizes[lo:hi]
            index = np.arange(total[lo], total[hi]) + np.repeat(self._starts[words[lo:hi]] - total[lo:hi], span)
            ids[total[lo] : total[hi]] = self._flat[index]
        return ids, total[bounds]

    def decode(self, ids: np.ndarray) -> bytes:
        """The UTF-8 bytes of ids; bytes that are no character become U+FFFD."""
        sizes = np.diff(self.token_ranges)[ids]
        total = np.concatenate([[0], np.cumsum(sizes)])
        index = np.arange(total[-1], dtype=np.int32) + np.repeat((self.token_ranges[ids] - total[:-1]).astype(np.int32), sizes)
        raw = self.token_bytes[index].tobytes()
        try:
            raw.decode("utf-8")
        except UnicodeDecodeError:
            return raw.decode("utf-8", errors="replace").encode("utf-8")
        return raw

    def decimal(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by commas."""
        rows = self.digits[ids].ravel()
        return rows[rows != 0][:-1].tobytes()


def _blocks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts of at most a block's bytes (one text at least)."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + tk.BLOCK_BYTES, side="right")) - 1
        end = min(max(end, row + 1), n)
        lo, hi = int(offsets[row]), int(offsets[end])
        yield lo, hi, data[lo:hi], offsets[row : end + 1] - lo
        row = end


_encoders: dict[str, PairIndexBPE] = {}


def encoder(path: str) -> PairIndexBPE:
    """One encoder per worker process and vocabulary file."""
    if path not in _encoders:
        _encoders[path] = PairIndexBPE(path)
    return _encoders[path]


def encoded_chunks(batches: Iterator[pa.RecordBatch], bpe: PairIndexBPE, column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of a batch with the ids of their texts, a bounded chunk at a time."""
    for batch in batches:
        for first, end, data, offsets in tk.text_blocks(batch.column(column), CHUNK_BYTES):
            ids, ranges = bpe.encode_texts(data, offsets)
            yield batch.slice(first, end - first), ids, ranges


def encode(docs: DataFrame, path: str | None = None, column: str = "text", into: str = "token_ids") -> DataFrame:
    """``docs`` with a column of token ids, ``array<int>``, in place of any of its name; null counts as empty."""
    path = path or tokenizer_path()
    schema = StructType([*docs.drop(into).schema.fields, StructField(into, ArrayType(IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ids, ranges in encoded_chunks(batches, encoder(path), column):
            lists = pa.ListArray.from_arrays(pa.array(ranges, pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*rows.columns, lists], [*rows.schema.names, into])

    return docs.drop(into).transform(map_arrow, run, schema)


def decode(docs: DataFrame, path: str | None = None, column: str = "token_ids", into: str = "decoded") -> DataFrame:
    """``docs`` with the text that its token ids stand for, in place of any column of its name; null counts as no ids."""
    path = path or tokenizer_path()
    schema = StructType([*docs.drop(into).schema.fields, StructField(into, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            texts = [bpe.decode(np.array(ids or [], dtype=np.int64)).decode("utf-8") for ids in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, into])

    return docs.drop(into).transform(map_arrow, run, schema)


def _digests(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for rows, ids, ranges in encoded_chunks(batches, bpe):
            parts = [ids[ranges[i] : ranges[i + 1]] for i in range(rows.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"),
                    pa.array(np.diff(ranges), pa.int64()),
                    pa.array([hashlib.sha256(bpe.decimal(p)).hexdigest() for p in parts], pa.string()),
                    pa.array([hashlib.sha256(bpe.decode(p)).hexdigest() for p in parts], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def round_trip_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row: doc_id, the number of tokens and digests of ids and decoded text.

    Ids and text are made and hashed in one pass, so neither is shuffled.  Null
    and empty texts have no tokens; repeated rows give repeated rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.transform(map_arrow, _digests(path or tokenizer_path()), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
