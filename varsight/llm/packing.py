"""Packing of token pieces into fixed-length sequences by length patterns.

Only the histogram of piece lengths reaches the driver, at most ``capacity``
numbers at any input size.  Patterns of two to four lengths that fill a
sequence are enumerated, how often to repeat each is fitted to the histogram
by non-negative least squares and rounded down, and what is left is packed by
patterns built around the longest remaining length.  A plan is therefore a
bounded list of patterns with repeat counts, whatever the number of pieces.

A piece finds its place by arithmetic from its rank among pieces of its
length: ranks come from per-task counts and one prefix sum per length, so a
length that a third of all pieces share is no hot spot.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoded_chunks, encoder
from .common import map_arrow, materialize, tokenizer_path

Pattern = tuple[tuple[tuple[int, int], ...], int]  # ((length, times), ...), repeats

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, lane int, lane_rank long"


def _cut(path: str, capacity: int, end_id: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane = TaskContext.get().partitionId()
        ranks = np.zeros(capacity + 1, dtype=np.int64)
        for rows, ids, ranges in encoded_chunks(batches, encoder(path)):
            which, piece, start, length, crc = [], [], [], [], []
            for d in range(rows.num_rows):
                raw = np.append(ids[ranges[d] : ranges[d + 1]], end_id).astype("<u4").tobytes()
                n = len(raw) // 4
                at = 0
                for p in range(-(-n // capacity)):
                    size = (n % capacity or capacity) if p == 0 else capacity
                    which.append(d), piece.append(p), start.append(at), length.append(size)
                    crc.append(zlib.crc32(raw[4 * at : 4 * (at + size)]))
                    at += size
            sizes = np.array(length, dtype=np.int64)
            order = np.argsort(sizes, kind="stable")
            ordered = sizes[order]
            first = np.searchsorted(ordered, ordered, side="left")
            rank = np.empty(len(sizes), dtype=np.int64)
            rank[order] = ranks[ordered] + np.arange(len(sizes)) - first
            ranks += np.bincount(sizes, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id").take(pa.array(which, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(sizes),
                    pa.array(crc, pa.int64()),
                    pa.array(np.full(len(sizes), lane), pa.int32()),
                    pa.array(rank),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32", "lane", "lane_rank"],
            )

    return run


def _candidates(lengths: np.ndarray, capacity: int, per_length: int = 6) -> np.ndarray:
    """Patterns of two to four present lengths, 0 pads.

    For each length as the longest of its pattern: the length that completes it,
    and for ``per_length`` second lengths, spread over those that fit, the
    longest third and then fourth length that still fit.
    """
    below = np.zeros(capacity + 1, dtype=np.int64)
    below[lengths] = lengths
    below = np.maximum.accumulate(below)  # the longest present length up to each room
    rows = []
    for a in lengths.tolist():
        room = capacity - a
        fits = lengths[lengths <= min(a, room)]
        if not len(fits):
            continue
        pick = np.unique(np.linspace(0, len(fits) - 1, per_length).round().astype(int))
        for b in [*fits[pick].tolist(), int(min(a, below[room]))]:
            c = int(below[min(b, room - b)])
            d = int(below[min(c, room - b - c)])
            rows.append((a, b, c, d))
    return np.unique(np.array(rows, dtype=np.int64).reshape(-1, 4), axis=0)


def _fit_repeats(rows: np.ndarray, counts: np.ndarray, capacity: int, steps: int = 3000) -> np.ndarray:
    """Non-negative least squares of pattern repeats against the histogram.

    Accelerated projected gradient.  One more equation asks for no unused
    tokens, so that of equal fits the tighter one is found.
    """
    size, columns = len(counts), rows.shape[1]
    waste = (capacity - rows.sum(axis=1)).astype(float)
    target = counts.copy()
    target[0] = 0

    def forward(x: np.ndarray) -> np.ndarray:
        y = np.bincount(rows.ravel(), weights=np.repeat(x, columns), minlength=size)
        y[0] = waste @ x
        return y

    def backward(y: np.ndarray) -> np.ndarray:
        return np.where(rows > 0, y[rows], 0).sum(axis=1) + waste * y[0]

    v = np.ones(len(rows))
    for _ in range(30):
        v = backward(forward(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = z = np.zeros(len(rows))
    t = 1.0
    for _ in range(steps):
        slope = backward(forward(z) - target)
        new = np.maximum(z - slope / (1.02 * norm), 0)
        if slope @ (new - x) > 0:  # restart where momentum points uphill
            t = 1.0
        t, last = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        z = new + (last - 1) / t * (new - x)
        x = new
    return x


def _around_longest(left: np.ndarray, capacity: int) -> list[int]:
    """A pattern of remaining lengths: the longest, then the fullest completion."""
    left = left.copy()
    present = np.flatnonzero(left)
    parts = [int(present[-1])]
    left[parts[0]] -= 1
    room = capacity - parts[0]
    while room > 0:
        fits = np.flatnonzero(left[: room + 1])
        if not len(fits):
            break
        pick = int(fits[-1])
        if pick != room:
            # two lengths that fill the room beat the longest one that fits
            other = room - fits
            ok = (left[other] > 0) & (fits >= other) & ((fits != other) | (left[fits] > 1))
            if ok.any():
                pick = int(fits[ok][-1])
        parts.append(pick)
        left[pick] -= 1
        room -= pick
    return parts


def plan_patterns(histogram: dict[int, int], capacity: int = 1024) -> list[Pattern]:
    """Patterns and repeats that use every length exactly as often as it occurs."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        if not 0 < length <= capacity:
            raise ValueError(f"a length of {length} does not fit {capacity}")
        left[length] += n
    plan: list[Pattern] = []

    def use(parts: list[int], most: int | None = None) -> None:
        times = np.bincount(parts, minlength=capacity + 1)
        kinds = np.flatnonzero(times)
        repeats = int((left[kinds] // times[kinds]).min())
        if most is not None:
            repeats = min(repeats, most)
        if repeats > 0:
            left[kinds] -= repeats * times[kinds]
            plan.append((tuple((int(k), int(times[k])) for k in kinds[::-1]), repeats))

    if left[capacity]:
        use([capacity])
    lengths = np.flatnonzero(left)
    rows = _candidates(lengths, capacity) if len(lengths) else np.zeros((0, 4), int)
    if len(rows):
        x = _fit_repeats(rows, left.astype(float), capacity)
        for c in np.argsort(-x, kind="stable"):
            if x[c] >= 1:
                use([int(v) for v in rows[c] if v], int(x[c]))
    while left.any():
        use(_around_longest(left, capacity))
    return plan


def _place(plan: list[Pattern]) -> tuple[np.ndarray, ...]:
    """For each length, runs of ranks and where they lie, sorted by (length, first rank)."""
    used: dict[int, int] = {}
    rows = []
    sequence = 0
    for parts, repeats in plan:
        offset = 0
        for length, times in parts:
            first = used.get(length, 0)
            rows.append((length, first, times, sequence, offset))
            used[length] = first + repeats * times
            offset += length * times
        sequence += repeats
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return tuple(table[:, k] for k in range(5))


def _assign(places: object) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, firsts, times, sequences, offsets = places.value
        bound = np.append(np.searchsorted(lengths, np.arange(lengths[-1] + 2 if len(lengths) else 1)), len(lengths))
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            at = np.empty(len(length), dtype=np.int64)
            order = np.argsort(length, kind="stable")
            cut = np.flatnonzero(np.concatenate([[True], np.diff(length[order]) != 0])) if len(order) else []
            for lo, hi in zip(cut, np.append(cut[1:], len(order)) if len(order) else [], strict=True):
                rows = order[lo:hi]
                n = length[rows[0]]
                at[rows] = bound[n] + np.searchsorted(firsts[bound[n] : bound[n + 1]], rank[rows], side="right") - 1
            k = rank - firsts[at]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequences[at] + k // times[at]), pa.array(offsets[at] + k % times[at] * length)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, capacity: int = 1024, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Pieces of all documents and their places in sequences of ``capacity`` tokens.

    A document is its token ids and ``end_id``; a longer one is cut into pieces
    of ``capacity`` of which the first may be shorter.  Null and empty texts are
    one piece of ``end_id`` alone; repeated rows and ids are pieces of their
    own; an empty table gives an empty result.  Sequences count from 0; within
    one, offsets have no gaps.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = materialize(rows.transform(map_arrow, _cut(path or tokenizer_path(), capacity, end_id), _PIECES), "pieces")
    lanes = pieces.groupBy("length", "lane").agg((F.max("lane_rank") + 1).alias("n"))
    before = Window.partitionBy("length").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    lanes = materialize(lanes.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "lanes")
    histogram = {r["length"]: r["n"] for r in lanes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = spark.sparkContext.broadcast(_place(plan_patterns(histogram, capacity)))
    # lanes has a row per task and length, which grows with the input: both sides are shuffled by both keys
    bases = lanes.select("length", "lane", "base").hint("merge")
    ranked = pieces.join(bases, ["length", "lane"]).withColumn("rank", F.col("base") + F.col("lane_rank"))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return ranked.transform(map_arrow, _assign(places), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
