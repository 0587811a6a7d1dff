"""Exact top-k inner products by a three-phase uniform threshold.

A vector's components are dealt to ``lists`` slices.  In a cell of some queries
and some candidates each slice is a list of local scores, which add up to the
score.  Phase one gathers, in every cell, the best of each local list and their
whole scores: the k-th best of those over all cells is a safe cutoff t.  Phase
two gives it back to the queries' cells, where each list answers with the
candidates of at least t / lists; any other is below t in sum.  Those whose
known and bounded parts reach t are resolved in phase three, and each cell
returns those of at least t, the k best of them if they are more.

Cells are a grid of blocks of queries and of candidates, so no task holds more
than a block of each, whatever the number of rows or of equal vectors.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


@dataclass(frozen=True)
class TopkConfig:
    """k: results of a query.  every: ids divisible by this are queries.  scale:
    components are multiplied by it and rounded down.  lists: slices of the
    components.  query_block, candidate_block: rows of a cell on average.
    tile: queries that are scored at a time.
    """

    k: int = 20
    every: int = 20
    scale: float = 64.0
    lists: int = 4
    query_block: int = 1024
    candidate_block: int = 2048
    tile: int = 128


DEFAULT = TopkConfig()


def _matrix(column: pa.ChunkedArray, width: int, scale: float) -> np.ndarray:
    """Scaled vectors as whole numbers; shorter ones are filled up with zeros."""
    lists = column.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.floor(scale * flat)
    return out


def _whole(values: np.ndarray) -> np.ndarray:
    """Scores as 64-bit integers; beyond their range the nearest of them."""
    if values.dtype == object:
        return np.array([min(max(int(v), _LOW), _HIGH) for v in values.ravel()], np.int64).reshape(values.shape)
    return values.astype(np.int64)


class _Cell:
    """Blocks of queries and candidates, and the local score lists of a tile of the queries."""

    def __init__(self, table: pa.Table, cfg: TopkConfig):
        asks = table.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        queries, candidates = table.filter(pa.array(asks)), table.filter(pa.array(~asks))
        self.uid = queries.column("uid").to_numpy(zero_copy_only=False)
        self.query_id = queries.column("vec_id").to_numpy(zero_copy_only=False)
        self.cutoffs = queries.column("cutoff").to_pylist()
        self.own = candidates.column("uid").to_numpy(zero_copy_only=False)
        self.ids = candidates.column("vec_id").to_numpy(zero_copy_only=False)
        lengths = [c.value_lengths() for c in table.column("embedding").chunks]
        width = max([1, *(int(x) for c in lengths for x in [max(c.to_numpy(zero_copy_only=False), default=0)])])
        self.q, self.x = _matrix(queries.column("embedding"), width, cfg.scale), _matrix(candidates.column("embedding"), width, cfg.scale)
        largest = np.abs(self.q).max(initial=0) * np.abs(self.x).max(initial=0) * width * cfg.lists
        if not largest < 2.0**53:  # else sums of products are exact as doubles
            self.q, self.x = (np.array([[int(v) for v in row] for row in m], object).reshape(m.shape) for m in (self.q, self.x))
        self.slices = [s for s in np.array_split(np.arange(width), cfg.lists) if len(s)]

    def local(self, at: slice) -> list[np.ndarray]:
        return [self.q[at][:, s] @ self.x[:, s].T for s in self.slices]

    def tiles(self, size: int):
        if len(self.own):
            for i in range(0, len(self.uid), size):
                yield slice(i, min(i + size, len(self.uid)))


def _gather(cfg: TopkConfig) -> Callable:
    """Phase one: for each query the k best whole scores among the best of every local list."""

    def run(table: pa.Table) -> pa.Table:
        cell = _Cell(table, cfg)
        uids, scores = [], []
        for at in cell.tiles(cfg.tile):
            lists = cell.local(at)
            k = min(cfg.k + 1, len(cell.own))  # one more, as the query may be its own best
            best = [np.argpartition(-x if x.dtype != object else (-_whole(x).astype(float)), k - 1, axis=1)[:, :k] for x in lists]
            found = np.sort(np.concatenate(best, axis=1), axis=1)
            total = sum(np.take_along_axis(x, found, axis=1) for x in lists)
            fresh = np.ones(found.shape, bool)
            fresh[:, 1:] = found[:, 1:] != found[:, :-1]
            fresh &= cell.own[found] != cell.uid[at][:, None]
            row, col = np.nonzero(fresh)
            whole = _whole(total[row, col])
            order = np.lexsort((~whole, row))
            row, whole = row[order], whole[order]
            top = np.arange(len(row)) - np.searchsorted(row, row) < cfg.k
            uids.append(cell.uid[at][row[top]])
            scores.append(whole[top])
        return pa.table([pa.array(np.concatenate(uids) if uids else [], pa.int64()), pa.array(np.concatenate(scores) if scores else [], pa.int64())], ["uid", "score"])

    return run


def _resolve(cfg: TopkConfig) -> Callable:
    """Phases two and three: candidates that some list has at the uniform threshold, then whole scores from the cutoff."""

    def run(table: pa.Table) -> pa.Table:
        cell = _Cell(table, cfg)
        out: list[list[np.ndarray]] = [[], [], [], []]
        for at in cell.tiles(cfg.tile):
            lists, m = cell.local(at), len(cell.slices)
            known = np.array([c is not None for c in cell.cutoffs[at]])
            exact = lists[0].dtype == object
            cutoff = np.array([0 if c is None else c for c in cell.cutoffs[at]], object if exact else np.float64)[:, None]
            part = np.zeros(lists[0].shape, object if exact else np.float64)
            some = np.zeros(lists[0].shape, bool)
            for x in lists:
                scaled = x * m
                seen = (scaled >= cutoff).astype(bool)
                some |= seen
                part += np.where(seen, scaled, cutoff)
            # what no list shows is below the cutoff; what the rest cannot lift to it is as well
            left = (some & (part >= cutoff * m).astype(bool)) | ~known[:, None]
            row, col = np.nonzero(left)
            total = sum(x[row, col] for x in lists)
            keep = (cell.own[col] != cell.uid[at][row]) & ((total >= cutoff[row, 0]).astype(bool) | ~known[row])
            row, col, whole = row[keep], col[keep], _whole(total[keep])
            order = np.lexsort((cell.ids[col], ~whole, row))
            row, col, whole = row[order], col[order], whole[order]
            top = np.arange(len(row)) - np.searchsorted(row, row) < cfg.k
            for column, values in zip(out, (cell.uid[at][row[top]], cell.query_id[at][row[top]], cell.ids[col[top]], whole[top]), strict=True):
                column.append(values)
        return pa.table([pa.array(np.concatenate(c) if c else [], pa.int64()) for c in out], ["uid", "query_id", "vec_id", "score"])

    return run


def _cells(rows: DataFrame, queries: DataFrame, columns: int, lines: int) -> DataFrame:
    """Every candidate once for each block of queries, every query once for each block of candidates."""
    deal = lambda n: F.pmod(F.xxhash64("uid"), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    candidates = rows.select(deal(columns).alias("column"), each(lines).alias("line"), "uid", "vec_id", "embedding", F.lit(False).alias("asks"), F.lit(None).cast("long").alias("cutoff"))
    asking = queries.select(each(columns).alias("column"), deal(lines).alias("line"), "uid", "vec_id", "embedding", F.lit(True).alias("asks"), "cutoff")
    return candidates.unionByName(asking).groupBy("column", "line")


def top_inner_products(vectors: DataFrame, cfg: TopkConfig = DEFAULT) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` of ``vectors(vec_id, embedding)``.

    Each row whose id is divisible by ``every`` asks for its k highest inner
    products with other rows, of components multiplied by ``scale`` and rounded
    down; ties go to the smaller id.  With fewer other rows, all are returned.

    Rows without an id, and vectors that are null or hold a null or non-finite
    component, take no part.  Repeated rows are rows of their own: each asks,
    and is found by the others.  Shorter vectors count as filled up with zeros.
    Scores beyond a 64-bit integer count as the nearest one.  Other columns are
    ignored; an empty table gives an empty result.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite)
    rows = materialize(rows.withColumn("uid", F.monotonically_increasing_id()), "vectors")
    queries = rows.where(F.col("vec_id") % cfg.every == 0)
    columns, lines = max(1, -(-rows.count() // cfg.candidate_block)), max(1, -(-queries.count() // cfg.query_block))
    unknown = queries.withColumn("cutoff", F.lit(None).cast("long"))
    local = _cells(rows, unknown, columns, lines).applyInArrow(_gather(cfg), "uid long, score long")
    place = F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("score")))
    cutoffs = local.withColumn("place", place).where(F.col("place") <= cfg.k).where(F.col("place") == cfg.k).select("uid", F.col("score").alias("cutoff"))
    asking = materialize(queries.join(cutoffs, "uid", "left"), "cutoffs")
    found = _cells(rows, asking, columns, lines).applyInArrow(_resolve(cfg), "uid long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= cfg.k).select("query_id", "rank", "vec_id", "score")
