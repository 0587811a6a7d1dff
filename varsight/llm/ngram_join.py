"""Similarity self-join on word n-grams, indexed by a count-vector R-tree.

Shingles are hashed into ``GROUPS`` groups; a document's counts per group are
a point, and the sum over groups of the smaller coordinate bounds the overlap
of two sets from above.  An R-tree over these points holds, for each node, the
largest value of each coordinate, so the same sum bounds the overlap with
everything below the node.  What the bound leaves is verified on the sets.

The tree is cut into tasks by families: documents that could reach the
similarity at all.  With J(A, B) >= t both sets keep at least t of their size
in common, so of any order of the shingles the first ``n - ceil(t n) + k`` of
each set share k or more.  Every document ships that prefix with k a fifth of
its size; one that does not find k of its prefix shingles anywhere else links
with nothing and leaves.  Of the k or more that a pair shares, one is left when
each set drops its k - 1 most widely held ones, so passages that many documents
share drop out.  The rest form families over shared shingles, and a family is
one R-tree, or several tiles of one where it is large.

Exact copies are one class with one node; classes carry a 64-bit hash of the
shingle set.  The result is exact up to collisions of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkernels as tk
from .common import free_name, map_arrow, materialize
from .graph import connected_components

GROUPS = 64
_SHIFT = np.uint64(58)  # the upper six bits name a shingle's group
_MANY = 4096


@dataclass(frozen=True)
class JoinConfig:
    """width: words of a shingle.  percent: least Jaccard similarity in hundredths.

    tile_docs, tile_shingles: documents and shingles of one R-tree tile, and of
    a block that asks it, on average, as a hash deals them.  hubs: members of a
    large family that all its tiles hold.  order_bits: size of the table of
    counts that orders the shingles; any order gives the same result, this one
    puts those last that many documents hold.  filter_bits: size of the bitmap
    that keeps unneeded sets out of a shuffle.  salts: parts of a large family
    where its members meet its figures.
    """

    width: int = 5
    percent: int = 75
    tile_docs: int = 1024
    tile_shingles: int = 2_000_000
    hubs: int = 64
    order_bits: int = 21
    filter_bits: int = 1 << 25
    salts: int = 64

    def least_common(self, n: np.ndarray) -> np.ndarray:
        return np.maximum(1, n // 5)

    def prefix(self, n: np.ndarray) -> np.ndarray:
        return np.minimum(n, n - (self.percent * n + 99) // 100 + self.least_common(n))


DEFAULT = JoinConfig()


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of ``(first row, end row, shingles, ranges, class ids, sizes)``."""
    for first, end, data, offsets in tk.text_blocks(batch.column("text")):
        words, ranges = tk.word_hashes(data, offsets)
        flat, ranges = tk.distinct_runs(*tk.shingle_hashes(words, ranges, width))
        sizes = np.diff(ranges)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tk.mix64(flat), dtype=np.uint64)])
        classes = tk.mix64((sums[ranges[1:]] - sums[ranges[:-1]]) ^ (sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        yield first, end, flat, ranges, classes.view(np.int64), sizes


def _classify(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [(c, s) for *_, c, s in _sets(batch, width)]
            classes = np.concatenate([c for c, _ in parts]) if parts else np.zeros(0, np.int64)
            sizes = np.concatenate([s for _, s in parts]) if parts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(classes), pa.array(sizes)], ["doc_id", "class_id", "n_shingles"])

    return run


def classify(docs: DataFrame, cfg: JoinConfig = DEFAULT) -> DataFrame:
    """``(doc_id, class_id, n_shingles)``: equal shingle sets have equal class ids."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.transform(map_arrow, _classify(cfg.width), "doc_id long, class_id long, n_shingles long")


def _new_classes(seen: set[int], classes: np.ndarray, sizes: np.ndarray) -> list[int]:
    rows = []
    for i, (c, n) in enumerate(zip(classes.tolist(), sizes.tolist(), strict=True)):
        if n and c not in seen:
            seen.add(c)
            rows.append(i)
    return rows


_PART = 1 << 13  # counts of one row of the table


def _tally(cfg: JoinConfig) -> Callable:
    """How many of a task's classes hold a shingle of each hash, as rows ``(part, counts)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << cfg.order_bits, dtype=np.uint32)
        mask = np.uint64(len(counts) - 1)
        seen: set[int] = set()
        for batch in batches:
            for _, _, flat, ranges, classes, sizes in _sets(batch, cfg.width):
                new = np.zeros(len(sizes), dtype=bool)
                new[_new_classes(seen, classes, sizes)] = True
                np.add.at(counts, (flat[np.repeat(new, sizes)] & mask).astype(np.int64), np.uint32(1))
        for part, row in enumerate(counts.reshape(-1, min(_PART, len(counts)))):
            if row.any():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([row.tobytes()], pa.binary())], ["part", "counts"])

    return run


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of parts to ``(part, levels)``: eight times the binary logarithm of the summed counts."""
    part, total = None, None

    def told() -> pa.RecordBatch:
        levels = np.minimum(8 * np.log2(1 + total), 255).astype(np.uint8)
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([levels.tobytes()], pa.binary())], ["part", "levels"])

    for batch in batches:
        for p, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            row = np.frombuffer(raw, dtype=np.uint32).astype(float)
            if p == part:
                total += row
                continue
            if part is not None:
                yield told()
            part, total = p, row
    if part is not None:
        yield told()


def common_levels(texts: DataFrame, cfg: JoinConfig = DEFAULT) -> np.ndarray:
    """For each hash of a shingle, a level that grows with the number of documents that hold such a shingle.

    Counted over all documents, in a table of fixed size for each task and in sum.
    """
    rows = texts.select("text").transform(map_arrow, _tally(cfg), "part int, counts binary")
    rows = rows.repartition("part").sortWithinPartitions("part").transform(map_arrow, _levels, "part int, levels binary").collect()
    out = np.zeros(1 << cfg.order_bits, dtype=np.uint8)
    for r in rows:
        row = np.frombuffer(r["levels"], dtype=np.uint8)
        out[r["part"] * len(row) : (r["part"] + 1) * len(row)] = row
    return out


def _prefixes(cfg: JoinConfig, levels: object) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value
        mask = np.uint64(len(level) - 1)
        seen: set[int] = set()
        for batch in batches:
            for _, _, flat, ranges, classes, sizes in _sets(batch, cfg.width):
                rows = _new_classes(seen, classes, sizes)
                if not rows:
                    continue
                # each set in order of levels, then of the shingles themselves, as the sets come
                owner = np.repeat(np.arange(len(sizes)), sizes)
                order = np.argsort(owner << 8 | level[(flat & mask).astype(np.int64)], kind="stable")
                takes = cfg.prefix(sizes)[rows]
                first = ranges[rows]
                ends = np.cumsum(takes)
                at = np.arange(ends[-1]) + np.repeat(first - ends + takes, takes)
                yield pa.RecordBatch.from_arrays([pa.array(flat[order[at]].view(np.int64)), pa.array(np.repeat(classes[rows], takes))], ["key", "class_id"])

    return run


def _repeated_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, class) to ``(class_id, key, held)`` for keys that several classes hold.

    held is the number of classes, or ``_MANY`` for that many and more, so that
    no more than that of one key is kept at once.
    """
    k = np.zeros(0, dtype=np.int64)
    c = np.zeros(0, dtype=np.int64)
    many = None  # a key of which _MANY rows have been told, and the last class of them

    def told(classes: np.ndarray, keys: np.ndarray, held: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(classes), pa.array(keys), pa.array(held.astype(np.int64))], ["class_id", "key", "held"])

    for batch in batches:
        k = np.concatenate([k, batch.column(0).to_numpy()])
        c = np.concatenate([c, batch.column(1).to_numpy()])
        if many is not None and len(k):
            more = int(np.searchsorted(k, many[0], side="right"))
            if more:
                fresh = np.diff(c[:more], prepend=many[1]) != 0
                if fresh.any():
                    yield told(c[:more][fresh], k[:more][fresh], np.full(int(fresh.sum()), _MANY))
                many = many[0], c[more - 1]
                k, c = k[more:], c[more:]
            if len(k):
                many = None
        if not len(k):
            continue
        fresh = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])])
        k, c = k[fresh], c[fresh]
        cut = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        last = cut[-1]
        sizes = np.diff(cut)
        held = np.repeat(sizes, sizes)
        several = held > 1
        if several.any():
            yield told(c[:last][several], k[:last][several], np.minimum(held[several], _MANY))
        k, c = k[last:], c[last:]
        if len(k) >= _MANY:
            yield told(c, k, np.full(len(k), _MANY))
            many = k[0], c[-1]
            k, c = k[:0], c[:0]
    if len(k) > 1:
        yield told(c, k, np.full(len(k), min(len(k), _MANY)))


def _hubs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, class) to ``(class_id, hub)``; a key's hub is its smallest class."""
    key = first = None
    for batch in batches:
        k = batch.column(0).to_numpy()
        c = batch.column(1).to_numpy()
        if not len(k):
            continue
        new = np.concatenate([[k[0] != key], k[1:] != k[:-1]])
        start = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
        hub = np.where(start >= 0, c[np.maximum(start, 0)], first if first is not None else 0)
        key, first = k[-1], hub[-1]
        other = hub != c
        if other.any():
            pairs = np.unique(np.stack([c[other], hub[other]], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["class_id", "hub"])


def _wanted_sets(width: int, bitmap: object) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = bitmap.value
        mask = len(words) * 64 - 1
        seen: set[int] = set()
        for batch in batches:
            for _, _, flat, ranges, classes, sizes in _sets(batch, width):
                low = classes & mask
                hit = (words[low >> 6] >> (low & 63).astype(np.uint64)) & np.uint64(1)
                rows = [i for i in _new_classes(seen, np.where(hit > 0, classes, 0), np.where(hit > 0, sizes, 0)) if hit[i]]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(classes[rows]), pa.array([flat[ranges[i] : ranges[i + 1]].tobytes() for i in rows], pa.binary())], ["class_id", "shingles"]
                    )

    return run


class CountVectorTree:
    """R-tree over points of group counts, bulk-loaded by size and leading coordinate.

    A node keeps the largest value of each coordinate and the range of sizes.
    """

    FAN = 16

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        slab = self.FAN * self.FAN
        by_size = np.argsort(sizes, kind="stable")
        lead = int(np.argmax(points.var(axis=0))) if len(points) else 0
        self.order = np.concatenate([s[np.argsort(points[s, lead], kind="stable")] for s in (by_size[i : i + slab] for i in range(0, len(by_size), slab))]) if len(points) else by_size
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels = []  # from the leaves up: largest coordinates, least and largest size
        top, low, high = self.points, self.sizes, self.sizes
        while len(top) > self.FAN:
            cut = np.arange(0, len(top), self.FAN)
            top, low, high = np.maximum.reduceat(top, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            self.levels.append((top, low, high))

    def search(self, point: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Rows whose bound reaches the similarity, best bound first."""
        nodes = None
        for top, low, high in reversed(self.levels):
            nodes = np.arange(len(top)) if nodes is None else nodes[nodes < len(top)]
            bound = np.minimum(top[nodes], point).sum(axis=1)
            # overlap o reaches p/100 of the union when o (100 + p) >= p (a + b)
            fits = (bound * (100 + percent) >= percent * (low[nodes] + size)) & (high[nodes] * 100 >= percent * size) & (low[nodes] * percent <= 100 * size)
            nodes = (nodes[fits][:, None] * self.FAN + np.arange(self.FAN)).ravel()
        if nodes is None:
            nodes = np.arange(len(self.points))
        nodes = nodes[nodes < len(self.points)]
        bound = np.minimum(self.points[nodes], point).sum(axis=1)
        fits = bound * (100 + percent) >= percent * (self.sizes[nodes] + size)
        nodes, bound = nodes[fits], bound[fits]
        return self.order[nodes[np.argsort(-bound, kind="stable")]]


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


def tile_links(sets: list[np.ndarray], labels: np.ndarray, probes: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join all of a tile's components, as pairs of rows.

    labels: rows with equal labels are joined already.  probes: rows to search
    for; the others only answer.  A link is left out only where its ends are
    joined by other links.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    points = np.zeros((len(sets), GROUPS), dtype=np.int64)
    for i, s in enumerate(sets):
        points[i] = np.bincount((s >> _SHIFT).astype(np.int64), minlength=GROUPS)
    tree = CountVectorTree(points, sizes)
    _, comp = np.unique(labels, return_inverse=True)
    found = []
    for i in np.flatnonzero(probes):
        near = tree.search(points[i], sizes[i], percent)
        near = near[comp[near] != comp[i]]
        while len(near):
            j, near = near[0], near[1:]
            o = _overlap(sets[i], sets[j])
            if 100 * o >= percent * (sizes[i] + sizes[j] - o):
                found.append((int(i), int(j)))
                comp[comp == comp[j]] = comp[i]
                near = near[comp[near] != comp[i]]
    return found


def _link_tiles(percent: int) -> Callable:
    """Rows ``(family, tile, class_id, label, probe, shingles)`` in order of tiles to links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, rows = None, {}

        def links() -> Iterator[pa.RecordBatch]:
            if len(rows) > 1:
                ids = list(rows)
                labels = np.array([rows[c][0] for c in ids])
                probes = np.array([rows[c][1] for c in ids])
                pairs = tile_links([rows[c][2] for c in ids], labels, probes, percent)
                if pairs:
                    yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in pairs], pa.int64()), pa.array([ids[j] for _, j in pairs], pa.int64())], ["a", "b"])

        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(6)]
            for family, part, c, label, probe, blob in zip(*cols, strict=True):
                if (family, part) != tile:
                    yield from links()
                    tile, rows = (family, part), {}
                old = rows.get(c)
                rows[c] = (label, probe or (old is not None and old[1]), np.frombuffer(blob, dtype=np.uint64))
        yield from links()

    return run


def _links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """members: (family, tile, class_id, label, probe); sets: (class_id, shingles)."""
    rows = members.join(sets, "class_id").select("family", "tile", "class_id", "label", "probe", "shingles")
    rows = rows.repartition("family", "tile").sortWithinPartitions("family", "tile", "class_id")
    return rows.transform(map_arrow, _link_tiles(percent), "a long, b long")


def _figures(members: DataFrame, figures: DataFrame, cfg: JoinConfig) -> DataFrame:
    """Members with their family's figures; a large family's members meet them in several tasks."""
    salted = figures.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(cfg.salts - 1))))
    return members.withColumn("salt", F.pmod(F.xxhash64("class_id", F.lit(5)), F.lit(cfg.salts)).cast("int")).join(salted, ["family", "salt"], "left").drop("salt")


def _merged(joined: DataFrame, links: DataFrame, cfg: JoinConfig) -> DataFrame:
    """``joined``, as ``connected_components`` gives it, with further links, whose ends are named by their components first."""
    for end in ("a", "b"):
        links = links.join(joined, F.col(end) == F.col("node"), "left").withColumn(end, F.coalesce("component", end)).select("a", "b")
    more = connected_components(links)
    nodes = joined.unionByName(more.select("node", F.col("node").alias("component"))).distinct()
    nodes = _figures(nodes.toDF("class_id", "family"), more.select(F.col("node").alias("family"), "component"), cfg)
    return nodes.select(F.col("class_id").alias("node"), F.coalesce("component", "family").alias("component"))


def link_classes(docs: DataFrame, classes: DataFrame, cfg: JoinConfig = DEFAULT) -> DataFrame:
    """``(node, component)`` over the class ids that link with another class."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    levels = sc.broadcast(common_levels(texts, cfg))
    keys = texts.select("text").transform(map_arrow, _prefixes(cfg, levels), "key long, class_id long")
    keys = keys.repartition("key").sortWithinPartitions("key", "class_id")
    repeated = keys.transform(map_arrow, _repeated_keys, "class_id long, key long, held long")
    sizes = classes.groupBy("class_id").agg(F.max("n_shingles").alias("n_shingles"))
    # k of the smallest set that can be similar; a set with fewer repeated keys links with nothing
    need = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n_shingles") * cfg.percent / 100) / 5))
    ranked = repeated.join(sizes, "class_id").withColumn("need", need)
    mine = Window.partitionBy("class_id")
    ranked = ranked.withColumn("found", F.count(F.lit(1)).over(mine)).withColumn("place", F.row_number().over(mine.orderBy("held", "key")))
    rare = ranked.where("place <= found - need + 1").select("key", "class_id")
    edges = rare.repartition("key").sortWithinPartitions("key", "class_id").transform(map_arrow, _hubs, "class_id long, hub long")
    families = connected_components(edges.select(F.col("class_id").alias("a"), F.col("hub").alias("b")))
    members = families.select(F.col("node").alias("class_id"), F.col("component").alias("family")).join(sizes, "class_id")
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / cfg.tile_docs, F.sum("n_shingles") / cfg.tile_shingles))
    figures = members.groupBy("family").agg(F.count(F.lit(1)).alias("count"), parts.alias("tiles")).where("tiles > 1")
    members = _figures(members, figures, cfg).select("class_id", "family", F.coalesce("count", F.lit(1)).alias("count"), F.coalesce("tiles", F.lit(1)).alias("tiles"))
    members = materialize(members, "members")

    low = F.col("class_id").bitwiseAND(cfg.filter_bits - 1)
    bits = members.groupBy(F.shiftright(low, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast((class_id & {63}) as int))")).alias("bits")).toPandas()
    words = np.zeros(cfg.filter_bits // 64, dtype=np.uint64)
    words[bits["word"].to_numpy().astype(np.int64)] = bits["bits"].to_numpy().astype(np.int64).view(np.uint64)
    sets = texts.select("text").transform(map_arrow, _wanted_sets(cfg.width, sc.broadcast(words)), "class_id long, shingles binary")

    own = F.pmod(F.xxhash64("class_id"), F.col("tiles"))
    hub = (F.col("tiles") > 1) & (F.pmod(F.xxhash64("class_id", F.lit(7)), F.col("count")) < cfg.hubs)
    placed = members.withColumn("own", own).withColumn("tile", F.explode(F.when(hub, F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).otherwise(F.array("own"))))
    links = materialize(_links(placed.select("family", "tile", "class_id", F.col("class_id").alias("label"), F.lit(True).alias("probe")), sets, cfg.percent), "links")
    large = members.where("tiles > 1")
    if large.limit(1).count():
        joined = connected_components(links)
        large = large.join(joined, F.col("class_id") == F.col("node"), "left").drop("node").withColumn("label", F.coalesce("component", "class_id")).withColumn("own", own).drop("component")
        main = large.groupBy("family", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("family").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
        large = materialize(_figures(large, main, cfg).withColumn("probe", F.col("label") != F.col("main")), "large")
        # a task holds one block of those that ask and one tile of those that answer
        wanting = large.where("probe").groupBy("family").agg(F.ceil(F.count(F.lit(1)) * F.max("tiles") / F.max("count")).alias("blocks"))
        all_blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
        all_tiles = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
        tile = (F.col("block") * F.col("tiles") + F.col("own")).alias("tile")
        large = _figures(large, wanting, cfg).where("blocks is not null")
        answer = large.withColumn("block", all_blocks).select("family", tile, "class_id", "label", F.lit(False).alias("probe"))
        ask = large.where("probe").withColumn("block", F.pmod(F.xxhash64("class_id", F.lit(11)), F.col("blocks"))).withColumn("own", all_tiles)
        ask = ask.select("family", tile, "class_id", "label", "probe")
        return _merged(joined, _links(answer.unionByName(ask), sets, cfg.percent), cfg)
    return connected_components(links)


def ngram_components(docs: DataFrame, cfg: JoinConfig = DEFAULT) -> DataFrame:
    """Connected components of documents whose shingle sets reach the similarity.

    ``docs`` needs doc_id and text; other columns are ignored.  Returns one row
    per input row: doc_id, n_shingles, class_id (equal sets), component_id.
    A null, empty or blank text has no shingle, links with nothing and is its
    own component.  Rows that repeat are members of one class.  component_id is
    the smallest non-null doc_id of the component, null if it has none.
    """
    classes = materialize(classify(docs, cfg), "classes")
    filled = classes.where("n_shingles > 0")
    nodes = link_classes(docs, filled, cfg)
    smallest = filled.groupBy("class_id").agg(F.min("doc_id").alias("least"))
    named = smallest.join(nodes, F.col("node") == F.col("class_id"), "left").withColumn("component", F.coalesce("component", "class_id"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("class_id", "component_id")
    full = filled.join(named, "class_id", "left").select("doc_id", "n_shingles", "class_id", "component_id")
    empty = classes.where("n_shingles = 0").select("doc_id", "n_shingles", "class_id", F.col("doc_id").alias("component_id"))
    return full.unionByName(empty)


def keep_first(docs: DataFrame, cfg: JoinConfig = DEFAULT) -> DataFrame:
    """One row of each component stays, that with the smallest doc_id, with all its columns as they were.

    Rows with no words all stay.  Of rows that repeat an id within a component,
    one stays; a component without any id keeps one row.
    """
    columns = docs.columns
    row = free_name(docs, "row_number")
    stored = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "docs")
    found = ngram_components(stored.select(F.col(row).alias("doc_id"), "text"), cfg)
    found = found.select(F.col("doc_id").alias("place"), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("group"))
    ids = stored.select(F.col(row).alias("place"), F.col("doc_id").alias("id"))
    best = found.join(ids, "place").groupBy("group").agg(F.min_by("place", F.struct(F.col("id").isNull(), "id", "place")).alias(row)).select(row)
    return stored.join(best, row, "left_semi").select(*columns)


__all__ = ["JoinConfig", "classify", "keep_first", "link_classes", "ngram_components"]
