"""How the sources of a language differ in their words: a token-start pointer sort.

A shard is the Arrow buffer of some texts.  Pointers to the bytes at which words
start are sorted by the words, a slice for each language, with a multikey
quicksort whose characters are eight bytes long: pointers are parted by eight
bytes, and those that agree in them and go on are parted by the next eight.
Equal runs are the words, with the documents they are found in and their counts
by source.  No word is cut out of the buffer before it is known how often it
occurs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialize

_BYTES = np.arange(256)
_IN_WORD = (_BYTES >= 0x80) | ((_BYTES | 0x20 >= 0x61) & (_BYTES | 0x20 <= 0x7A) & (_BYTES >= 0x41))
_LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)
_RUNS = "lang string, term string, df long, sources array<string>, counts array<long>"


@dataclass(frozen=True)
class DivergenceConfig:
    """least_docs: documents of a language that a term needs.  smoothing: added
    to every count.  unit: what shares are multiplied by.  top: terms that a
    group reports.  shard_bytes: text that is sorted at a time; a text is never
    cut.  term_block, source_block: terms and sources of a cell of the
    comparison on average.
    """

    least_docs: int = 30
    smoothing: int = 5
    unit: int = 1_000_000_000
    top: int = 50
    shard_bytes: int = 24 << 20
    term_block: int = 8192
    source_block: int = 128


DEFAULT = DivergenceConfig()


def _eight(data: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The next eight bytes at each pointer as a number, zeros after the word's end; ``data`` ends with eight spare bytes."""
    view = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
    shift = (8 * (8 - np.minimum(left, 8))).astype(np.uint64)
    return (view[at].astype(np.uint64) >> shift) << shift


def multikey_runs(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pointers as places in ``start``, equal words next to each other, and the number of each one's run.

    All pointers are parted level by level; a run that is alone or whose words
    end at a level is done.  Words beyond 64 bytes are compared as bytes.
    """
    places: list[np.ndarray] = []
    runs: list[np.ndarray] = []
    count, depth = 0, 0
    active, group = np.arange(len(start)), np.zeros(len(start), np.int64)

    def done(at: np.ndarray, fresh: np.ndarray) -> None:
        nonlocal count
        places.append(at)
        runs.append(count - 1 + np.cumsum(fresh))
        count += int(fresh.sum())

    while len(active):
        if depth >= 64:
            words = [(int(g), data[p : p + n].tobytes()) for g, p, n in zip(group, start[active], size[active], strict=True)]
            order = sorted(range(len(words)), key=words.__getitem__)
            done(active[order], np.array([i == 0 or words[order[i]] != words[order[i - 1]] for i in range(len(order))]))
            break
        key = _eight(data, start[active] + depth, size[active] - depth)
        goes_on = size[active] > depth + 8
        for part in (~goes_on, goes_on):
            at, k, g = active[part], key[part], group[part]
            order = np.argsort(k) if depth == 0 else np.lexsort((k, g))
            at, k, g = at[order], k[order], g[order]
            fresh = np.ones(len(at), bool)
            fresh[1:] = (k[1:] != k[:-1]) | (g[1:] != g[:-1])
            if part is not goes_on:
                done(at, fresh)
                continue
            run = np.cumsum(fresh) - 1
            alone = np.bincount(run, minlength=1)[run] == 1 if len(run) else np.zeros(0, bool)
            done(at[alone], np.ones(int(alone.sum()), bool))
            rest, rest_group = at[~alone], run[~alone]
        active, group, depth = rest, rest_group, depth + 8
    return np.concatenate([np.zeros(0, np.int64), *places]), np.concatenate([np.zeros(0, np.int64), *runs])


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes and lengths of the words of texts that lie at ``offsets``; no word goes over a text's end."""
    inside = _IN_WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = offsets[:-1] < offsets[1:]
    first[offsets[:-1][full]] = inside[offsets[:-1][full]]
    last[offsets[1:][full] - 1] = inside[offsets[1:][full] - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1 - start


def _shard_runs(texts: pa.Array, langs: list[str], sources: list[str]) -> Iterator[pa.RecordBatch]:
    """A row for each word and language of a shard: documents, and counts by source."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
    if offsets[-1] == offsets[0]:
        return
    data = np.frombuffer(texts.buffers()[2], np.uint8, int(offsets[-1] - offsets[0]), int(offsets[0]))
    offsets = offsets - offsets[0]
    start, size = _words(data, offsets)
    data = np.concatenate([_LOWER[data], np.zeros(8, np.uint8)])
    doc = np.searchsorted(offsets, start, "right") - 1
    lang_names, lang_of = np.unique(np.array(langs, object), return_inverse=True)
    source_names, source_of = np.unique(np.array(sources, object), return_inverse=True)
    spoken = lang_of[doc]
    for code, lang in enumerate(lang_names):
        own = np.flatnonzero(spoken == code)
        place, run = multikey_runs(data, start[own], size[own])
        if not len(place):
            continue
        place = own[place]
        pairs, times = np.unique(run * len(texts) + doc[place], return_counts=True)
        run_of, doc_of = np.divmod(pairs, len(texts))
        cells, back = np.unique(run_of * len(source_names) + source_of[doc_of], return_inverse=True)
        counts = np.bincount(back, times, len(cells)).astype(np.int64)
        run_of_cell, source = np.divmod(cells, len(source_names))
        n_runs = int(run[-1]) + 1
        docs = np.bincount(run_of, minlength=n_runs)
        edges = np.searchsorted(run_of_cell, np.arange(n_runs + 1))
        head = place[np.searchsorted(run, np.arange(n_runs))]
        raw = data.tobytes()
        for i in range(0, n_runs, 32_768):
            j = min(i + 32_768, n_runs)
            terms = pa.array([raw[p : p + n] for p, n in zip(start[head[i:j]].tolist(), size[head[i:j]].tolist(), strict=True)], pa.binary()).cast(pa.string())
            at = pa.array(edges[i : j + 1] - edges[i], pa.int32())
            names = pa.ListArray.from_arrays(at, pa.array(source_names[source[edges[i] : edges[j]]], pa.string()))
            values = pa.ListArray.from_arrays(at, pa.array(counts[edges[i] : edges[j]]))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (j - i), pa.string()), terms, pa.array(docs[i:j], pa.int64()), names, values], ["lang", "term", "df", "sources", "counts"])


def _sort_shards(cfg: DivergenceConfig) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def shard() -> Iterator[pa.RecordBatch]:
            texts = pa.concat_arrays([b.column(0) for b in held])
            yield from _shard_runs(texts, *([x for b in held for x in b.column(k).to_pylist()] for k in (1, 2)))

        for batch in batches:
            held.append(batch)
            size += batch.column(0).nbytes
            if size >= cfg.shard_bytes:
                yield from shard()
                held, size = [], 0
        if held:
            yield from shard()

    return run


def term_counts(documents: DataFrame, cfg: DivergenceConfig = DEFAULT) -> DataFrame:
    """``(lang, term, source, n, all_n, leads)`` of the kept terms; ``n`` is above 0.

    ``all_n`` is the count in the whole language, ``leads`` marks one row of
    each term.  Shards' runs of a term meet by one shuffle, in which the rare
    terms, most of all, are dropped before their sources are laid out.
    """
    runs = documents.transform(map_arrow, _sort_shards(cfg), _RUNS)
    same = Window.partitionBy("lang", "term")
    kept = runs.withColumn("docs", F.sum("df").over(same)).where(F.col("docs") >= cfg.least_docs)
    kept = kept.select("lang", "term", F.inline(F.arrays_zip("sources", "counts"))).withColumnsRenamed({"sources": "source", "counts": "n"})
    kept = kept.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"))
    return kept.withColumns({"all_n": F.sum("n").over(same), "leads": F.row_number().over(same.orderBy("source")) == 1})


def _share(count: Column, total: Column, terms: Column, cfg: DivergenceConfig) -> Column:
    """1 + floor(unit * (count + s) / (total + s * terms)); decimals keep it exact."""
    wide = "decimal(28,0)"
    top = (count.cast("decimal(20,0)") + cfg.smoothing).cast("decimal(20,0)") * F.lit(cfg.unit).cast("decimal(10,0)")
    below = (total.cast(wide) + terms.cast(wide) * cfg.smoothing).cast(wide)
    quotient = F.call_function("div", top, F.when(below > 0, below))
    return quotient + 1


def _compare(key: tuple, table: pa.Table) -> pa.Table:
    """Sums of differences of shares between two blocks of sources, over a block of terms.

    Rows without a term have a source's share of terms that it lacks.  A pair's
    sum over the terms that no source of the cell has is left out but for the
    first block, which adds that difference for all terms of the language; other
    rows then add by how much they exceed it.
    """
    lang, block, low, high = (k.as_py() for k in key)
    names = np.array(table.column("source").to_pylist(), object)
    side, share = table.column("side").to_numpy(), table.column("share").to_numpy()
    terms = table.column("term").combine_chunks()
    terms = pa.concat_arrays(terms.chunks) if isinstance(terms, pa.ChunkedArray) else terms
    is_term = terms.is_valid().to_numpy(zero_copy_only=False)
    codes = terms.dictionary_encode().indices
    codes = codes.fill_null(0).to_numpy(zero_copy_only=False)
    n_terms = int(codes[is_term].max()) + 1 if is_term.any() else 0
    vocabulary = int(table.column("vocabulary").to_numpy()[0])
    found, matrices = [], []
    for block_side in (low, high):
        own = side == block_side
        base = own & ~is_term
        sources, at = np.unique(names[base], return_index=True)
        lacking = share[base][at]
        dense = np.repeat(lacking[:, None], n_terms, axis=1)
        rows = own & is_term
        dense[np.searchsorted(sources, names[rows]), codes[rows]] = share[rows]
        found.append((sources, lacking))
        matrices.append(dense)
    (left, left_lacks), (right, right_lacks) = found
    out_a, out_b, out_v = [], [], []
    for i, name in enumerate(left):
        plain = np.abs(right_lacks - left_lacks[i])
        value = np.abs(matrices[1] - matrices[0][i]).sum(axis=1) - n_terms * plain + (vocabulary * plain if block == 0 else 0)
        use = right != name if low != high else right > name
        out_a += [name] * int(use.sum())
        out_b += right[use].tolist()
        out_v.append(value[use])
    values = np.concatenate(out_v) if out_v else np.zeros(0, np.int64)
    return pa.table([pa.array([lang] * 2 * len(values), pa.string()), pa.array(out_a + out_b, pa.string()), pa.array(out_b + out_a, pa.string()), pa.array(np.concatenate([values, values]), pa.int64())], ["lang", "source", "item", "value"])


def source_divergence(documents: DataFrame, cfg: DivergenceConfig = DEFAULT) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` of ``documents(text, lang, source)``.

    Part ``pair`` holds, for every group of a language and source, its distance
    from each other source of the language: the sum over the kept terms of the
    absolute differences of shares.  Part ``term`` holds the ``top`` kept terms
    that a group uses more than its language does.

    Null text, lang and source count as empty.  Every row is a document, repeated
    ones as well.  Groups without terms take part with counts of 0; a language
    without kept terms has distances of 0.  Ties are ordered by the item's UTF-8
    bytes.  Other columns are ignored; an empty table gives an empty result.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = documents.select(blank("text"), blank("lang"), blank("source"))
    counts = materialize(term_counts(docs, cfg), "terms")
    langs = counts.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.count(F.when(F.col("leads"), 1)).alias("vocabulary"))
    groups = docs.select("lang", "source").distinct()
    groups = groups.join(counts.groupBy("lang", "source").agg(F.sum("n").alias("group_n")), ["lang", "source"], "left").join(langs, "lang", "left")
    groups = materialize(groups.na.fill(0, ["group_n", "lang_n", "vocabulary"]), "groups")
    most_terms, most_sources = groups.groupBy("lang").agg(F.max("vocabulary").alias("v"), F.count(F.lit(1)).alias("s")).agg(F.max("v"), F.max("s")).first()
    blocks, sides = max(1, -(-(most_terms or 0) // cfg.term_block)), max(1, -(-(most_sources or 0) // cfg.source_block))

    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block")
    facts = groups.select("*", every)
    block = F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("long").alias("block")
    # a group's terms are dealt to the blocks, so that no group is the work of one task
    priced = counts.select("lang", "source", "term", "n", "all_n", block).join(facts, ["lang", "source", "block"])
    priced = priced.withColumns({"share": _share(F.col("n"), F.col("group_n"), F.col("vocabulary"), cfg), "lang_share": _share(F.col("all_n"), F.col("lang_n"), F.col("vocabulary"), cfg)})
    priced = materialize(priced.select("lang", "source", "block", "term", "share", "lang_share", "vocabulary"), "shares")

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    above = priced.where("share > lang_share").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("share") - F.col("lang_share")).alias("value"))
    above = above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cfg.top)

    lacking = F.coalesce(_share(F.lit(0), F.col("group_n"), F.col("vocabulary"), cfg), F.lit(0).cast("long")).alias("share")
    points = facts.select("lang", "source", "block", F.lit(None).cast("string").alias("term"), lacking, "vocabulary").unionByName(priced.drop("lang_share"))
    points = points.withColumn("side", F.pmod(F.xxhash64("source"), F.lit(sides)).cast("long"))
    points = points.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(sides - 1).cast("long"))))
    points = points.withColumns({"low": F.least("side", "other"), "high": F.greatest("side", "other")}).drop("other")
    near = points.groupBy("lang", "block", "low", "high").applyInArrow(_compare, "lang string, source string, item string, value long")
    near = near.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    near = near.withColumn("rank", F.row_number().over(order))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return near.select(*columns).unionByName(above.select(*columns))
