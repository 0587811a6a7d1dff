"""Prefix trie of conversations that reuse each other's first turns.

A node is a distinct sequence of first turns.  It is known by a prefix hash that
composes: the hash of two runs of turns follows from those of the parts, so a
conversation of any length is hashed in pieces by many tasks, and exchanging its
first turns for another's changes the later hashes by a known term.  Results are
exact up to collisions of 127-bit hashes.

Sums over subtrees are rolled up in bands of ``band`` levels.  A node explodes to
its ancestors within its band alone; the roots of bands, with what their bands
sum to, are a trie of their own of that many times fewer levels, rolled up in
the same way; the completed totals of band roots then go to their ancestors in
the band above.  Rounds are the logarithm of the depth to the base ``band``, and
a node is exploded at most ``band`` times in each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize

_PRIME = (1 << 127) - 1
_BASE = int.from_bytes(hashlib.sha256(b"turn").digest()[:16], "big") % _PRIME
_ROOT = (1).to_bytes(16, "big")
_NOTHING = hashlib.sha256(b"").hexdigest()


@dataclass(frozen=True)
class TrieConfig:
    """family: conversations share the first turns of that whose id is the next
    multiple of this below.  borrowed: a conversation takes fewer than this
    many.  band: levels of a band.  range_rows: turns of a range that one task
    hashes, at most on average.  salts: parts into which the children of a node
    are dealt where they look it up.  chunk: ids of a node's list that are kept
    together.
    """

    family: int = 100
    borrowed: int = 6
    band: int = 16
    range_rows: int = 1_000_000
    salts: int = 32
    chunk: int = 8192


DEFAULT = TrieConfig()


def _batch(columns: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema.names)


_SEGMENT = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("k", pa.int64()), ("state", pa.binary()), ("before", pa.binary()), ("size", pa.int64())])


def _hash_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns to positions and prefix hashes within the part of a conversation that a range holds."""
    conv, k, state = None, 0, 0
    for batch in batches:
        rows = []
        for c, part, digest, size in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if c != conv:
                conv, k, state = c, 0, 0
            before, k = state, k + 1
            state = (state * _BASE + int.from_bytes(digest, "big") + 1) % _PRIME
            rows.append((c, part, k, state.to_bytes(16, "big"), before.to_bytes(16, "big"), size))
        if rows:
            yield _batch(list(zip(*rows, strict=True)), _SEGMENT)


_CHAIN = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("offset", pa.int64()), ("start", pa.binary())])


def _chain_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of conversations in order, to the turns before each and their hash."""
    conv, offset, state = None, 0, 1
    for batch in batches:
        rows = []
        for c, part, n, own in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if c != conv:
                conv, offset, state = c, 0, 1
            rows.append((c, part, offset, state.to_bytes(16, "big")))
            state = (state * pow(_BASE, n, _PRIME) + int.from_bytes(own, "big")) % _PRIME
            offset += n
        if rows:
            yield _batch(list(zip(*rows, strict=True)), _CHAIN)


_HEAD = pa.schema([("conv_id", pa.int64()), ("pos", pa.int64()), ("state", pa.binary()), ("size", pa.int64())])


def _hash_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for c, k, state, size, offset, start in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            whole = (int.from_bytes(start, "big") * pow(_BASE, k, _PRIME) + int.from_bytes(state, "big")) % _PRIME
            rows.append((c, offset + k, whole.to_bytes(16, "big"), size))
        if rows:
            yield _batch(list(zip(*rows, strict=True)), _HEAD)


_PATH = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("node", pa.binary()), ("parent", pa.binary()), ("size", pa.int64()), ("ends", pa.int64())])


def _hash_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A conversation's own turns after those it gives up, with the hashes of the rebuilt sequence."""
    for batch in batches:
        rows = []
        for c, k, state, before, size, offset, start, skip, taken, length, skipped, lead in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            after = offset + k - skip
            first, change = int.from_bytes(start, "big"), int.from_bytes(lead, "big") - int.from_bytes(skipped, "big")
            parent = (int.from_bytes(before, "big") + first * pow(_BASE, k - 1, _PRIME) + change * pow(_BASE, after - 1, _PRIME)) % _PRIME
            node = (int.from_bytes(state, "big") + first * pow(_BASE, k, _PRIME) + change * pow(_BASE, after, _PRIME)) % _PRIME
            rows.append((c, taken + after, node.to_bytes(16, "big"), parent.to_bytes(16, "big"), size, int(taken + after == length)))
        if rows:
            yield _batch(list(zip(*rows, strict=True)), _PATH)


def _turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, digest, size)``; the digest is that of role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.char_length(text).cast("long").alias("size"))
    return rows.where("conv_id is not null")


def rebuilt_paths(conversations: DataFrame, cfg: TrieConfig = DEFAULT) -> DataFrame:
    """Every first-turn sequence of every rebuilt conversation: ``(conv_id, depth, node, parent, size, ends)``.

    Turns are dealt by ranges of (conversation, turn), so a conversation may be
    spread over any number of tasks; where it is, a row for each part says what
    comes before.  Those rows are as many as conversations and ranges together.
    """
    spark = conversations.sparkSession
    turns = materialize(_turns(conversations), "turns")
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns.count() // cfg.range_rows))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest")]
    ordered = turns.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    ordered = ordered.select("conv_id", F.spark_partition_id().cast("long").alias("part"), "digest", "size")
    segments = materialize(ordered.transform(map_arrow, _hash_segments, "conv_id long, part long, k long, state binary, before binary, size long"), "segments")

    parts = segments.groupBy("conv_id", "part").agg(F.max("k").alias("n"), F.max_by("state", "k").alias("state"))
    chained = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part").transform(map_arrow, _chain_segments, "conv_id long, part long, offset long, start binary")
    chained = materialize(chained, "chained")
    heads = segments.where(F.col("k") < cfg.borrowed).join(chained, ["conv_id", "part"]).where(F.col("offset") + F.col("k") < cfg.borrowed)
    heads = heads.select("conv_id", "k", "state", "size", "offset", "start").transform(map_arrow, _hash_heads, "conv_id long, pos long, state binary, size long")
    # fewer than ``borrowed`` entries each
    heads = heads.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "state", "size"))).alias("heads"))
    convs = parts.groupBy("conv_id").agg(F.sum("n").alias("n")).join(heads, "conv_id", "left")
    bases = convs.where(F.col("conv_id") % cfg.family == 0).select(F.col("conv_id").alias("base"), F.col("heads").alias("base_heads"))
    wanted = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % cfg.borrowed).cast("int")
    # at most ``family`` conversations ask for a base
    facts = convs.withColumns({"wanted": wanted, "base": F.col("conv_id") - F.col("conv_id") % cfg.family}).join(bases, "base", "left")
    facts = facts.withColumn("lead", F.when(F.col("base_heads").isNotNull(), F.slice("base_heads", 1, F.col("wanted"))))
    facts = facts.withColumns({"taken": F.coalesce(F.size("lead"), F.lit(0)).cast("long"), "skip": F.least(F.col("wanted").cast("long"), "n")})
    facts = facts.withColumn("taken", F.greatest("taken", F.lit(0)))
    root = F.lit(_ROOT)
    state_at = lambda c, n: F.when(F.col(n) > 0, F.element_at(c, F.col(n).cast("int"))["state"]).otherwise(root)
    facts = facts.select(
        "conv_id", "lead", "taken", "skip", (F.col("taken") + F.col("n") - F.col("skip")).alias("length"), state_at("heads", "skip").alias("skipped"), state_at("lead", "taken").alias("lead_state")
    )
    facts = materialize(facts, "facts")

    ends = (F.col("depth") == F.col("length")).cast("long").alias("ends")
    top = facts.select("conv_id", F.lit(0).cast("long").alias("depth"), root.alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("size"), "length")
    borrowed = facts.where("taken > 0").select("conv_id", "lead", "length", F.posexplode("lead"))
    parent = F.when(F.col("pos") > 0, F.get("lead", F.col("pos") - 1)["state"]).otherwise(root)
    borrowed = borrowed.select("conv_id", (F.col("pos") + 1).cast("long").alias("depth"), F.col("col.state").alias("node"), parent.alias("parent"), F.col("col.size").alias("size"), "length")
    shared = top.unionByName(borrowed).select("conv_id", "depth", "node", "parent", "size", ends)
    known = chained.join(facts.drop("lead"), "conv_id")
    own = segments.join(known, ["conv_id", "part"]).where(F.col("offset") + F.col("k") > F.col("skip"))
    own = own.select("conv_id", "k", "state", "before", "size", "offset", "start", "skip", "taken", "length", "skipped", "lead_state")
    own = own.transform(map_arrow, _hash_own, "conv_id long, depth long, node binary, parent binary, size long, ends long")
    return materialize(shared.unionByName(own), "paths")


def _limbs(path: DataFrame, band: int) -> DataFrame:
    """The nodes of a conversation's path in a band, in order: at most ``band`` of them."""
    at = path.withColumn("band", F.floor(F.col("depth") / band).cast("long"))
    return at.groupBy("conv_id", "band").agg(F.transform(F.sort_array(F.collect_list(F.struct("depth", "node"))), lambda x: x["node"]).alias("limb"))


def roll_up(path: DataFrame, nodes: DataFrame, sums: list[str], band: int) -> DataFrame:
    """``(node, *sums)``: each node's columns ``sums``, summed over its subtree, itself included.

    ``path(conv_id, depth, node)`` has a row for each node on a conversation's
    way from depth 0; ``nodes(node, conv_id, depth, *sums)`` names one of the
    conversations that pass through a node.
    """
    limbs = materialize(_limbs(path, band), "limbs")
    own = nodes.withColumn("band", F.floor(F.col("depth") / band).cast("long")).groupBy("conv_id", "band").agg(F.collect_list(F.struct("depth", *sums)).alias("own"))

    def gather(rows: DataFrame, above) -> DataFrame:
        """Sums by node of what goes to all nodes of a limb, or to those down to ``above``."""
        to = rows.select(F.explode(above).alias("node"), *sums)
        return to.groupBy("node").agg(*[F.sum(c).alias(c) for c in sums])

    each = limbs.join(own, ["conv_id", "band"]).select("limb", "band", F.explode("own").alias("x")).select("limb", "band", "x.*")
    inner = materialize(gather(each, F.slice("limb", 1, (F.col("depth") - F.col("band") * band + 1).cast("int"))), "band")
    if (nodes.agg(F.max("depth")).first()[0] or 0) < band:
        return inner
    roots = nodes.where(F.col("depth") % band == 0).select("node", "conv_id", (F.col("depth") / band).cast("long").alias("depth"))
    steps = limbs.select("conv_id", F.col("band").alias("depth"), F.get("limb", F.lit(0)).alias("node"))
    complete = roll_up(steps, roots.join(inner, "node"), sums, band)
    lower = roots.where("depth > 0").join(complete, "node").select("conv_id", (F.col("depth") - 1).alias("band"), *sums)
    spread = gather(lower.join(limbs, ["conv_id", "band"]), F.col("limb"))
    total = inner.unionByName(spread).groupBy("node").agg(*[F.sum(c).alias(c) for c in sums])
    return materialize(total, "band")


_LIST = pa.schema([("node", pa.binary()), ("part", pa.int64()), ("seq", pa.int64()), ("ids", pa.string())])


def _list_ids(chunk: int) -> Callable:
    """Sorted (node, conv_id) to pieces of each node's comma-joined list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, part, seq, held = None, 0, 0, []
        for batch in batches:
            rows = []
            for x, c, p in zip(*(v.to_pylist() for v in batch.columns), strict=True):
                if held and (x != node or len(held) == chunk):
                    rows.append((node, part, seq, ",".join(held)))
                    held = []
                seq = 0 if x != node else seq + (not held)
                node, part = x, p
                held.append(str(c))
            if rows:
                yield _batch(list(zip(*rows, strict=True)), _LIST)
        if held:
            yield _batch([[node], [part], [seq], [",".join(held)]], _LIST)

    return run


def _digest_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node, running = None, None
    schema = pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())])
    for batch in batches:
        rows = []
        for x, _, _, ids in zip(*(v.to_pylist() for v in batch.columns), strict=True):
            if x != node:
                if running is not None:
                    rows.append((node, running.hexdigest()))
                node, running = x, hashlib.sha256()
            else:
                running.update(b",")
            running.update(ids.encode())
        if rows:
            yield _batch(list(zip(*rows, strict=True)), schema)
    if running is not None:
        yield _batch([[node], [running.hexdigest()]], schema)


def _end_digests(path: DataFrame, cfg: TrieConfig) -> DataFrame:
    """``(node, ends_sha256)`` of nodes where conversations end.

    Ids are sorted and joined by ranges of (node, id), so a node where very many
    end is listed by many tasks.  A digest itself is sequential: its task streams
    through the pieces of the list and holds one at a time.
    """
    ends = path.where("ends = 1").select("node", "conv_id")
    ranges = int(path.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(ranges, -(-ends.count() // cfg.range_rows))
    ordered = ends.repartitionByRange(ranges, "node", "conv_id").sortWithinPartitions("node", "conv_id").select("node", "conv_id", F.spark_partition_id().cast("long").alias("part"))
    lists = ordered.transform(map_arrow, _list_ids(cfg.chunk), "node binary, part long, seq long, ids string")
    return lists.repartition("node").sortWithinPartitions("node", "part", "seq").transform(map_arrow, _digest_lists, "node binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, cfg: TrieConfig = DEFAULT) -> DataFrame:
    """A row per node of the trie of ``conversations(conv_id, turn, role, text)``, rebuilt.

    A conversation c takes the first h turns of c - c % ``family`` (all, if that
    has fewer; none, if it is absent), where h is crc32 of the decimal c modulo
    ``borrowed``, and goes on with its own turns after its first h.

    Turns are ordered by number, nulls first; turns of equal number by the
    SHA-256 of length of the role, colon, role and text.  Null role and text are
    empty.  Rows without a conv_id belong to no conversation and are left out;
    repeated rows are turns of their own.  Other columns are ignored.  An empty
    table has no node, not even a root.
    """
    path = rebuilt_paths(conversations, cfg)
    nodes = path.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent").alias("parent"), F.max("size").alias("size"), F.count(F.lit(1)).alias("n_convs"), F.sum("ends").alias("n_ends")
    )
    # a node has no child if all its members end there
    nodes = nodes.withColumns({"saved_tokens": (F.col("n_convs") - 1) * F.col("size"), "n_leaves": (F.col("n_ends") == F.col("n_convs")).cast("long")})
    nodes = materialize(nodes, "nodes")
    sums = ["saved_tokens", "n_leaves"]
    totals = roll_up(path.select("conv_id", "depth", "node"), nodes.select("node", "conv_id", "depth", *sums), sums, cfg.band)
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    ask = nodes.where("parent is not null").select("node", "parent", F.pmod(F.xxhash64("node"), F.lit(cfg.salts)).alias("salt"))
    answer = ask.select("parent", "salt").distinct().join(nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent")
    parents = ask.join(answer, ["parent", "salt"]).select("node", "parent_conv_id")
    out = nodes.select("node", "conv_id", "depth", "n_convs").join(totals, "node").join(children, "node", "left").join(parents, "node", "left").join(_end_digests(path, cfg), "node", "left")
    return out.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(_NOTHING)).alias("ends_sha256"),
    )
