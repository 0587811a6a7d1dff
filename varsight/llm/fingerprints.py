"""Document fingerprints by consistent weighted sampling.

A text is a bag of five-word shingles weighted by how often it holds them.
Each of ``samples`` draws gives every term two gamma variates r and c and a
uniform b, which depend on the term and the draw alone; a term of weight w has
t = floor(ln w / r + b) and the value ln c - r (t - b) - r, and the smallest
value is the sample.  Two texts agree in a sample with a probability equal to
the generalised Jaccard similarity of their bags.  As the value is a function
of term and t alone, it stands for the pair.

The variates come from hashed bits through tables of their quantiles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import textkernels as tk
from .common import map_arrow, materialize

BLOCK_CHARS = 600_000
ROWS = 2048  # terms whose values are made at a time
_BITS = 14


@dataclass(frozen=True)
class FingerprintConfig:
    """samples: draws of a fingerprint, four hexadecimal digits each.  width: words of a term.
    range_chars: code points of a range of ids, on average, that one task goes through.
    """

    samples: int = 64
    width: int = 5
    range_chars: int = 32 << 20


DEFAULT = FingerprintConfig()


@cache
def _quantiles() -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of a gamma variate of shape 2, and of its logarithm."""
    n = 1 << _BITS
    grid = np.linspace(1e-9, 40, 400_001)
    cdf = 1 - np.exp(-grid) * (1 + grid)
    gamma = np.interp((np.arange(n) + 0.5) / n, cdf, grid)
    return gamma.astype(np.float32), np.log(gamma).astype(np.float32)


@cache
def _draws(samples: int) -> np.ndarray:
    return np.random.default_rng(6).integers(1, 1 << 63, size=samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sample_values(terms: np.ndarray, steps: np.ndarray | None, samples: int) -> np.ndarray:
    """Values of every term in every draw; ``steps`` are the logarithms of the weights, None for 1."""
    gamma, log_gamma = _quantiles()
    g = terms[:, None] * _draws(samples)
    g ^= g >> np.uint64(29)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    r = gamma[g >> np.uint64(64 - _BITS)]
    b = ((g >> np.uint64(12)) & np.uint64(0xFFFFFF)).astype(np.float32) * np.float32(2.0**-24)
    v = log_gamma[(g >> np.uint64(64 - 2 * _BITS)) & np.uint64((1 << _BITS) - 1)] + r * (b - np.float32(1))
    if steps is not None:
        v -= r * np.floor(steps[:, None].astype(np.float32) / r + b)
    return v


def signatures(texts: list[str], cfg: FingerprintConfig = DEFAULT) -> tuple[np.ndarray, np.ndarray]:
    """16-bit samples, one row per text, and which texts have a term at all."""
    out = np.zeros((len(texts), cfg.samples), dtype=np.uint16)
    some = np.zeros(len(texts), dtype=bool)
    for first, end, data, offsets in tk.text_blocks(pa.array(texts, pa.large_string())):
        words, ranges = tk.word_hashes(data, offsets, lower=False)
        flat, ranges = tk.shingle_hashes(words, ranges, cfg.width)
        counts = np.diff(ranges)
        if not len(flat):
            continue
        distinct, index = np.unique(flat, return_inverse=True)
        owner = np.repeat(np.arange(len(counts), dtype=np.int64), counts)
        pairs, times = np.unique(owner << 32 | index, return_counts=True)
        owner, index = pairs >> 32, pairs & 0xFFFFFFFF
        best = np.full((len(counts), cfg.samples), np.inf, dtype=np.float32)
        # terms held once have the same value in every text, so each is made once
        once = times == 1
        order = np.argsort(index[once], kind="stable")
        who, what = owner[once][order], index[once][order]
        bounds = np.searchsorted(what, np.arange(0, len(distinct) + ROWS, ROWS))
        for k in range(len(bounds) - 1):
            lo, hi = bounds[k], bounds[k + 1]
            if lo < hi:
                values = sample_values(distinct[k * ROWS : (k + 1) * ROWS], None, cfg.samples)
                near = np.argsort(who[lo:hi], kind="stable")
                _lower(best, who[lo:hi][near], values[what[lo:hi][near] - k * ROWS])
        many = np.flatnonzero(~once)
        for lo in range(0, len(many), ROWS):
            at = many[lo : lo + ROWS]
            _lower(best, owner[at], sample_values(distinct[index[at]], np.log(times[at]), cfg.samples))
        bits = best.view(np.uint32)
        bits = (bits ^ (bits >> np.uint32(15))) * np.uint32(0x9E3779B1)
        out[first:end] = (bits >> np.uint32(16)).astype(np.uint16)
        some[first:end] = counts > 0
    return out, some


def _lower(best: np.ndarray, owner: np.ndarray, values: np.ndarray) -> None:
    """Lower the owners' minima by rows of values; owners are sorted."""
    cut = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    rows = owner[cut]
    best[rows] = np.minimum(best[rows], np.minimum.reduceat(values, cut, axis=0))


def as_text(signature: np.ndarray, some: bool) -> str:
    return signature.astype(">u2").tobytes().hex() if some else ""


def likeness(a: np.ndarray, b: np.ndarray, some_a: np.ndarray, some_b: np.ndarray) -> np.ndarray:
    """Share of equal samples; two texts without terms are alike, one alone is not."""
    return np.where(some_a & some_b, (a == b).mean(axis=1), (some_a == some_b).astype(float))


def fingerprint(documents: DataFrame, cfg: FingerprintConfig = DEFAULT, column: str = "text", into: str = "fingerprint") -> DataFrame:
    """``documents`` with a fingerprint; null texts and those without words have the empty one."""
    documents = documents.drop(into)
    schema = StructType([*documents.schema.fields, StructField(into, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, _, _ in tk.text_blocks(batch.column(column), BLOCK_CHARS):
                rows = batch.slice(first, end - first)
                found, some = signatures([t or "" for t in rows.column(column).to_pylist()], cfg)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([as_text(s, k) for s, k in zip(found, some, strict=True)], pa.string())], [*rows.schema.names, into])

    return documents.transform(map_arrow, run, schema)


def _chained(ids: list[int | None], texts: list[str], cfg: FingerprintConfig) -> pa.RecordBatch:
    """Results of all texts but the last; each is followed by its next document."""
    edited = []
    for text, after in zip(texts[:-1], texts[1:], strict=True):
        half = len(text) // 2
        edited.append(text[: len(text) - half] + after[:half])
    found, some = signatures(texts + edited, cfg)
    n = len(texts)
    own, changed = found[: n - 1], found[n:]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids[: n - 1], pa.int64()),
            pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(e.encode("utf-8")).hexdigest() for e in edited], pa.string()),
            pa.array([as_text(s, k) for s, k in zip(own, some, strict=False)], pa.string()),
            pa.array([as_text(s, k) for s, k in zip(changed, some[n:], strict=True)], pa.string()),
            pa.array(likeness(own, changed, some[: n - 1], some[n:])),
            pa.array(likeness(own, found[1:n], some[: n - 1], some[1:n])),
        ],
        _COLUMNS,
    )


def _compare(cfg: FingerprintConfig) -> Callable:
    """A range's ``doc_id, text`` in order to results of all rows but its last, and the texts at its two ends."""

    def inner(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        return pa.RecordBatch.from_arrays([*batch.columns, pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())], [*_COLUMNS, "bucket", "end", "text"])

    def end(name: str, bucket: int, doc_id: int | None, text: str) -> pa.RecordBatch:
        blank = [pa.nulls(1, pa.int64()), *(pa.nulls(1, pa.string()) for _ in range(3)), pa.nulls(1, pa.float64()), pa.nulls(1, pa.float64())]
        return pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), *blank, pa.array([bucket], pa.int32()), pa.array([name]), pa.array([text])], [*_COLUMNS, "bucket", "end", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = TaskContext.get().partitionId()
        ids: list[int | None] = []
        texts: list[str] = []
        size, begun = 0, False
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if not begun:
                    begun = True
                    yield end("head", bucket, doc_id, text)
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
                if size > BLOCK_CHARS and len(texts) > 1:
                    yield inner(_chained(ids, texts, cfg))
                    ids, texts, size = ids[-1:], texts[-1:], len(text)
        if begun:
            if len(texts) > 1:
                yield inner(_chained(ids, texts, cfg))
            yield end("tail", bucket, ids[-1], texts[-1])

    return run


def _compare_ends(cfg: FingerprintConfig) -> Callable:
    """The last document of a range and the first of the next one, ``doc_id, text, after``, to results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, after in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "after")), strict=True):
                if after is None:
                    raise ValueError("a range of ids is followed by an empty one")
                yield _chained([doc_id], [text, after], cfg)

    return run


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_COLUMNS = [c.split()[0] for c in _RESULT.split(", ")]


def compare_edited(documents: DataFrame, cfg: FingerprintConfig = DEFAULT) -> DataFrame:
    """Fingerprints of every text and of its edited text, and likenesses.

    The edited text has its last half replaced by the first characters of the
    next document in ascending doc_id; after the last comes the first.  Rows
    that repeat an id follow in the order of a hash of their texts; null ids
    come first, null texts are empty.  A lone row is its own next.  An empty
    table gives an empty result.

    Spark deals the rows by ranges of that order, of about ``range_chars`` each and
    four for each shuffle partition at least, so texts are shuffled once, rows that
    repeat an id are parted too, and no order is made over the whole table.  A
    task goes through its range and puts aside the texts at the two ends; results
    and ends are written, and the last document of each range meets the first
    of the next one in a join on the number of the range.  Ranges are consecutive:
    each ends with a row of its own, and only the last may have none.  The driver
    holds two numbers.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chars = rows.agg(F.sum(F.char_length("text"))).first()[0]
    if chars is None:
        return spark.createDataFrame([], _RESULT)
    ranges = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // cfg.range_chars))
    order = [F.coalesce("doc_id", F.lit(-(1 << 63))), F.xxhash64("text")]
    ranged = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    made = materialize(ranged.transform(map_arrow, _compare(cfg), f"{_RESULT}, bucket int, end string, text string"), "ranges")

    tails = made.where(F.col("end") == "tail").select("bucket", "doc_id", "text")
    last = tails.agg(F.max("bucket")).first()[0]
    tails = tails.withColumn("bucket", F.when(F.col("bucket") == last, F.lit(0)).otherwise(F.col("bucket") + 1))
    heads = made.where(F.col("end") == "head").select("bucket", F.col("text").alias("after"))
    ends = tails.join(heads, "bucket", "left").select("doc_id", "text", "after")
    return made.where(F.col("end").isNull()).select(_COLUMNS).unionByName(ends.transform(map_arrow, _compare_ends(cfg), _RESULT))
