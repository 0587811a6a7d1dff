"""Toxicity: a linear classifier on character n-grams scaled by log-count ratios.

A text's features are which hashed character n-grams it holds.  From the
labelled texts come naive Bayes log-count ratios, one per feature: the log of
how much more often toxic texts hold it than the others.  A logistic regression
is then trained on the features times their ratios, so that it starts from
naive Bayes and corrects what its independence assumption gets wrong.

A ratio counts as far as it lies beyond ``caution`` standard errors, so that
n-grams that are too rare to tell have none, and every n-gram whose ratio is
left takes part.  The fit uses at most ``fit_rows`` labelled rows, those with
the smallest hash of their ids; rows are put in the order of a hash of id and
text before they are folded and fitted, so the model depends on the rows alone
and not on how they are dealt to tasks.  Scoring covers every text whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import textkernels as tk
from .common import free_name, is_held_out, map_arrow, smallest

BLOCK_CHARS = 1 << 20


@dataclass(frozen=True)
class ToxicityConfig:
    """orders: lengths of the n-grams, in code points of the lower-cased text.

    bits: size of the hash space.  fit_rows: bound of the labelled sample.
    caution: standard errors by which a ratio is drawn towards 0.
    smoothing, l2, steps: of the ratios and the regression.  blend: share of
    the regression's own weights against their mean.  folds: of the rows that
    calibrate the scores.  threshold: least score that counts as toxic.
    """

    orders: tuple[int, ...] = (4, 5, 6)
    bits: int = 20
    fit_rows: int = 16_000
    caution: float = 4.0
    smoothing: float = 1.0
    l2: float = 3e-4
    blend: float = 0.9
    steps: int = 120
    folds: int = 3
    threshold: float = 0.3


DEFAULT = ToxicityConfig()
_STEP = np.uint32(0x9E3779B1)


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each between two blanks, blanks of any kind alike."""
    parts = [" " + t.lower() + " " for t in texts]
    points = np.frombuffer("".join(parts).encode("utf-32-le"), dtype=np.uint32).copy()
    points[(points >= 9) & (points <= 13)] = 0x20
    return points, np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def ngram_features(points: np.ndarray, ranges: np.ndarray, orders: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, hashed features and the number of the text that holds each."""
    owner = np.repeat(np.arange(len(ranges) - 1, dtype=np.int32), np.diff(ranges))
    base = points * np.uint32(0x85EBCA6B)
    base ^= base >> np.uint32(15)
    for n in orders:
        m = len(points) - n + 1
        if m <= 0:
            continue
        h = np.full(m, np.uint32(n * 0x27D4EB2F & 0xFFFFFFFF))
        for k in range(n):
            h = h * _STEP + base[k : k + m]
        h ^= h >> np.uint32(16)
        h *= np.uint32(0x7FEB352D)
        same = owner[:m] == owner[n - 1 :]
        yield (h >> np.uint32(32 - bits))[same], owner[:m][same]


def _batches_of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        for first, end, _, _ in tk.text_blocks(batch.column("text"), BLOCK_CHARS):
            rows = batch.slice(first, end - first)
            yield rows, [t or "" for t in rows.column("text").to_pylist()]


def _presence_counts(cfg: ToxicityConfig) -> Callable:
    """Per task, how many toxic and other texts hold each feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << cfg.bits), dtype=np.int32)
        for rows, texts in _batches_of_texts(batches):
            toxic = np.array(rows.column("toxic").to_pylist(), dtype=np.int64)
            points, ranges = _points(texts)
            for features, owner in ngram_features(points, ranges, cfg.orders, cfg.bits):
                pairs = np.unique(owner.astype(np.int64) << cfg.bits | features)
                feature, label = pairs & ((1 << cfg.bits) - 1), toxic[pairs >> cfg.bits]
                for c in (0, 1):
                    counts[c] += np.bincount(feature[label == c], minlength=1 << cfg.bits).astype(np.int32)
        seen = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(counts[1][seen].astype(np.int64)), pa.array(counts[0][seen].astype(np.int64))], ["feature", "toxic", "other"])

    return run


def _held_features(cfg: ToxicityConfig, rank: object) -> Callable:
    """Per text, the sorted numbers of the telling features it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rank.value
        for rows, texts in _batches_of_texts(batches):
            owner, feature = _chosen(texts, cfg, table)
            bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
            feature = feature.astype(np.int32)
            packed = [feature[lo:hi].tobytes() for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column("mark"), rows.column("toxic"), pa.array(packed, pa.binary())], ["mark", "toxic", "features"])

    return run


def _chosen(texts: list[str], cfg: ToxicityConfig, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and number of every telling feature that a text holds, once each, sorted."""
    points, ranges = _points(texts)
    found = []
    for features, owner in ngram_features(points, ranges, cfg.orders, cfg.bits):
        number = table[features]
        hit = number >= 0
        found.append(owner[hit].astype(np.int64) << 32 | number[hit])
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
    return pairs >> 32, pairs & 0xFFFFFFFF


@dataclass(frozen=True)
class ToxicityModel:
    """table: feature to its number or -1.  weights: by number.  bias: of the score."""

    config: ToxicityConfig
    table: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        owner, number = _chosen(texts, self.config, self.table)
        z = self.bias + np.bincount(owner, weights=self.weights[number], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


class _Rows:
    """Features held by each row, as one array of numbers with the rows' ends, gone through in bounded chunks."""

    CHUNK = 1 << 19

    def __init__(self, packed: list[bytes]):
        self.cols = np.frombuffer(b"".join(packed), dtype=np.int32)
        self.ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in packed])]).astype(np.int64)
        at = [0]
        while at[-1] < len(packed):
            at.append(max(at[-1] + 1, int(np.searchsorted(self.ends, self.ends[at[-1]] + self.CHUNK, side="right")) - 1))
        self.cuts = list(zip(at[:-1], at[1:], strict=True))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Per row, the sum of ``values`` over its features."""
        out = np.zeros(len(self.ends) - 1)
        for lo, hi in self.cuts:
            part = np.concatenate([[0.0], np.cumsum(values[self.cols[self.ends[lo] : self.ends[hi]]])])
            out[lo:hi] = np.diff(part[self.ends[lo : hi + 1] - self.ends[lo]])
        return out

    def spread(self, values: np.ndarray, size: int) -> np.ndarray:
        """Per feature, the sum of ``values`` over the rows that hold it."""
        out = np.zeros(size)
        for lo, hi in self.cuts:
            each = np.repeat(values[lo:hi], np.diff(self.ends[lo : hi + 1]))
            out += np.bincount(self.cols[self.ends[lo] : self.ends[hi]], weights=each, minlength=size)
        return out


def _norm(sums: Callable, spread: Callable, size: int, n: int, rounds: int = 20) -> float:
    """Largest eigenvalue of the features' and the constant's mean outer product over ``n`` rows."""
    v, norm = np.ones(size + 1), 1.0
    for _ in range(rounds):
        z = v[-1] + sums(v[:-1])
        v = np.append(spread(z), z.sum()) / max(n, 1)
        norm = np.linalg.norm(v) or 1.0
        v /= norm
    return float(norm)


def _descend(sums: Callable, spread: Callable, size: int, norm: float, labels: np.ndarray, keep: np.ndarray, l2: float, steps: int) -> tuple[np.ndarray, float]:
    """L2-regularised logistic regression on the rows of ``keep`` with weights of one sign, by accelerated gradients.

    sums: weights to the rows' sums.  spread: its transpose.  norm: of all rows.
    """
    n = max(int(keep.sum()), 1)
    rate = 1 / (0.26 * norm * len(labels) / n + l2)
    w, bias = np.zeros(size), 0.0
    wz, bz, t = w, bias, 1.0
    for _ in range(steps):
        z = bz + sums(wz)
        miss = np.where(keep, 1 / (1 + np.exp(-np.clip(z, -500, 500))) - labels, 0.0) / n
        new = np.maximum(wz - rate * (spread(miss) + l2 * wz), 0)
        new_bias = bz - rate * miss.sum()
        last, t = t, (1 + (1 + 4 * t * t) ** 0.5) / 2
        k = (last - 1) / t
        wz, bz = new + k * (new - w), new_bias + k * (new_bias - bias)
        w, bias = new, new_bias
    return w, float(bias)


def _regress(held: _Rows, labels: np.ndarray, fold: np.ndarray, ratios: np.ndarray, cfg: ToxicityConfig) -> tuple[np.ndarray, float]:
    """Weights of held features and a bias.

    The regression's weights multiply the ratios and keep their sign; they are
    drawn towards their mean, as naive Bayes weighs all ratios alike.  A scale
    and a bias make the scores probabilities: they are fitted to what each row
    gets from the rows of the other folds.
    """
    size, every = len(ratios), np.ones(len(labels), dtype=bool)
    moves = (lambda v: held.sums(v * ratios)), (lambda x: held.spread(x, size) * ratios)
    norm = _norm(*moves, size, len(labels))

    def weights(keep: np.ndarray) -> np.ndarray:
        w, _ = _descend(*moves, size, norm, labels, keep, cfg.l2, cfg.steps)
        return ((1 - cfg.blend) * w.mean() + cfg.blend * w) * ratios

    full = weights(every)
    z = np.zeros(len(labels))
    for k in range(cfg.folds):
        out = fold == k
        if out.any():
            # where the other folds lack a class, all rows serve
            z[out] = held.sums(weights(~out) if len(np.unique(labels[~out])) == 2 else full)[out]
    unit = np.abs(z).mean() + 1e-9
    z /= unit
    moves = (lambda v: z * v[0]), (lambda x: np.array([x @ z]))
    scale, bias = _descend(*moves, 1, _norm(*moves, 1, len(z)), labels, every, 1e-4, 1600)
    return full * scale[0] / unit, bias


def _fitted(cfg: ToxicityConfig, ratios: np.ndarray) -> Callable:
    """All rows ``(mark, toxic, features)``, in order, to weights and bias."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, labels, packed = [], [], []
        for batch in batches:
            marks += batch.column("mark").to_pylist()
            labels += batch.column("toxic").to_pylist()
            packed += batch.column("features").to_pylist()
        weights, bias = _regress(_Rows(packed), np.array(labels, dtype=float), np.array(marks) % cfg.folds, ratios, cfg)
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([bias])], ["weights", "bias"])

    return run


def fit(documents: DataFrame, labels: DataFrame, cfg: ToxicityConfig = DEFAULT) -> ToxicityModel:
    """Learn from labelled rows outside the held-out fold.

    Rows whose label or id is null are no labels; of labels that repeat an id
    the largest counts.  Without both classes, or a telling feature, every score
    is the share of toxic labels, about 0 without any.
    """
    sc = documents.sparkSession.sparkContext
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    chosen = chosen.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~is_held_out(F.col("doc_id")))
    chosen = chosen.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = smallest(chosen, cfg.fit_rows, F.xxhash64("doc_id"))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").select("text", "toxic", F.xxhash64("doc_id", "text").alias("mark"))

    counts = rows.transform(map_arrow, _presence_counts(cfg), "feature int, toxic long, other long")
    counts = counts.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    totals = rows.agg(F.sum("toxic"), F.count("toxic")).first()
    n_toxic, n = int(totals[0] or 0), int(totals[1])
    table = np.full(1 << cfg.bits, -1, dtype=np.int32)
    share = min(max(n_toxic / n if n else 0.0, 1e-9), 1 - 1e-9)
    constant = ToxicityModel(cfg, table, np.zeros(1), float(np.log(share / (1 - share))))
    if not 0 < n_toxic < n:
        return constant
    a = cfg.smoothing
    ratio = F.log((F.col("toxic") + a) / (n_toxic + 2 * a)) - F.log((F.col("other") + a) / (n - n_toxic + 2 * a))
    # what is left of a ratio beyond its standard error
    error = F.sqrt(1 / (F.col("toxic") + a) + 1 / (F.col("other") + a))
    sure = counts.select("feature", ratio.alias("ratio"), (F.abs(ratio) - cfg.caution * error).alias("sure")).where("sure > 0")
    best = sure.select("feature", "ratio").orderBy("feature").toPandas()
    if best.empty:
        return constant
    ratios = best["ratio"].to_numpy(dtype=float)
    table[best["feature"].to_numpy()] = np.arange(len(best), dtype=np.int32)
    sample = rows.transform(map_arrow, _held_features(cfg, sc.broadcast(table)), "mark long, toxic int, features binary")
    # one task fits the bounded sample; equal marks are equal rows, so their order is of no account
    sample = sample.repartition(1).sortWithinPartitions("mark", "toxic")
    fitted = sample.transform(map_arrow, _fitted(cfg, ratios), "weights binary, bias double").first()
    return ToxicityModel(cfg, table, np.frombuffer(fitted["weights"]), fitted["bias"])


def score(documents: DataFrame, model: ToxicityModel, into: str = "toxicity") -> DataFrame:
    """All columns of ``documents`` and ``into`` (0 to 1), from the text alone.

    A null text counts as empty; an empty text has the score of no features.  A
    column that has the name already is replaced.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    documents = documents.drop(into)
    schema = StructType([*documents.schema.fields, StructField(into, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in _batches_of_texts(batches):
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(shared.value.scores(texts))], [*rows.schema.names, into])

    return documents.transform(map_arrow, run, schema)


def score_documents(documents: DataFrame, labels: DataFrame, cfg: ToxicityConfig = DEFAULT) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``documents``."""
    model = fit(documents, labels, cfg)
    scored = score(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model)
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= cfg.threshold).cast("int").alias("predicted"))


def drop_toxic(documents: DataFrame, labels: DataFrame, cfg: ToxicityConfig = DEFAULT) -> DataFrame:
    """The rows that score below the threshold, with all their columns as they were."""
    model = fit(documents, labels, cfg)
    into = free_name(documents, "toxicity")
    return score(documents, model, into).where(F.col(into) < cfg.threshold).drop(into)
