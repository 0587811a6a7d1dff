"""The prefix trie, the exact top-k search and the divergence audit against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SCHEMA
from varsight.llm import divergence, prefix_trie, topk

CONVERSATIONS = "conv_id long, turn long, role string, text string"


def trie_by_hand(rows, family=100, borrowed=6):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0, digest), (role, text)))
    turns = {c: [t for _, t in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % borrowed
        whole = turns.get(c - int(math.fmod(c, family)), [])[:h] + mine[h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append(c)
        ends[tuple(whole)].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, m in members.items()
    )


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def conversations(seed=3):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 60), *range(100, 130), 250, 251, -7, 2**61]:
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["hello", "why?", "é" * 5, ""])))
    rows += [(c, t, "user", "same") for c in range(300, 340) for t in range(4)]
    rows += [(400, t, "user", f"long {t % 7}") for t in range(90)] + [(401, t, "user", f"long {t % 7}") for t in range(75)]
    rows += [(5, None, "user", "first"), (5, None, "user", "another first"), (5, 2, None, None), (7, 1, "a", "bc"), (7, 1, "ab", "c"), (7, 1, "ab", "c"), (None, 1, "user", "lost")]
    rows.append((9, 3, "user", "x" * 100_000))
    return rows


@pytest.mark.parametrize("cfg", [prefix_trie.DEFAULT, prefix_trie.TrieConfig(band=3, range_rows=20, salts=2, chunk=3)])
def test_trie_equals_brute_force(spark, cfg):
    rows = conversations()
    df = spark.createDataFrame(rows, CONVERSATIONS).repartition(5)
    assert rows_of(prefix_trie.prefix_trie(df, cfg)) == trie_by_hand(rows)


def test_trie_spreads_one_long_conversation_over_ranges(spark):
    rows = [(1, t, "user", f"{t % 11}") for t in range(600)] + [(c, 0, "user", "0") for c in range(2, 30)]
    df = spark.createDataFrame(rows, CONVERSATIONS)
    cfg = prefix_trie.TrieConfig(range_rows=50, band=8)
    assert rows_of(prefix_trie.prefix_trie(df, cfg)) == trie_by_hand(rows)


def test_trie_of_nothing_and_of_clashing_columns(spark):
    empty = spark.createDataFrame([], CONVERSATIONS)
    assert prefix_trie.prefix_trie(empty).count() == 0
    rows = [(c, t, "user", f"{c % 3} {t}") for c in range(8) for t in range(3)]
    extra = spark.createDataFrame(rows, CONVERSATIONS)
    for name in ("node", "depth", "part", "k", "state", "band", "salt", "parent", "size", "digest"):
        extra = extra.withColumn(name, F.lit("x"))
    assert rows_of(prefix_trie.prefix_trie(extra)) == trie_by_hand(rows)


VECTORS = "vec_id long, embedding array<double>"


def top_by_hand(rows, k=20):
    usable = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v) in enumerate(usable):
        if i % 20 == 0:
            scores = [(-min(max(sum(x * y for x, y in zip(v, w)), -(2**63)), 2**63 - 1), j) for b, (j, w) in enumerate(usable) if a != b]  # noqa: B905
            out += [(i, r, j, -s) for r, (s, j) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("cfg", [topk.DEFAULT, topk.TopkConfig(lists=3, query_block=4, candidate_block=30, tile=3)])
def test_topk_equals_brute_force(spark, cfg):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 0.2, 12).tolist()) for i in range(300)]
    rows += [(i, rows[40][1]) for i in range(300, 420)]  # one very common vector
    rows += [(20, rows[20][1]), (20, rows[20][1]), (None, [1.0] * 12), (440, None), (460, [1.0, None]), (480, [float("nan")]), (500, [float("inf")]), (520, []), (540, [0.5]), (541, [-0.01] * 12)]
    df = spark.createDataFrame(rows, VECTORS).repartition(4)
    assert rows_of(topk.top_inner_products(df, cfg)) == top_by_hand(rows)


def test_topk_with_few_rows_huge_values_and_no_rows(spark):
    few = [(0, [1.0, 2.0]), (1, [1.0, -3.0]), (2, [0.5, 0.5])]
    assert rows_of(topk.top_inner_products(spark.createDataFrame(few, VECTORS))) == top_by_hand(few)
    huge = [(i, [1e12 * (i + 1), -3e11 * i, 1.0]) for i in range(60)] + [(60, [1e300, 1.0, -1e300]), (80, [1e8 + 1 / 64, 1e8 - 1 / 64, 0.0])]
    assert rows_of(topk.top_inner_products(spark.createDataFrame(huge, VECTORS))) == top_by_hand(huge)
    alone = [(0, [1.0])]
    assert topk.top_inner_products(spark.createDataFrame(alone, VECTORS)).count() == 0
    assert topk.top_inner_products(spark.createDataFrame([], VECTORS)).count() == 0
    extra = spark.createDataFrame(few, VECTORS).withColumns({c: F.lit("x") for c in ("uid", "cutoff", "score", "rank", "asks", "line", "column", "place")})
    assert rows_of(topk.top_inner_products(extra)) == top_by_hand(few)


def test_topk_cells_hold_blocks(spark):
    """No cell grows with the table: candidates and queries are dealt to as many blocks as needed."""
    df = spark.range(4000).select(F.col("id").alias("uid"), F.col("id").alias("vec_id"), F.array(F.lit(1.0)).alias("embedding"), F.lit(None).cast("long").alias("cutoff"))
    sizes = topk._cells(df, df.where("vec_id % 20 = 0"), 20, 4).count()
    assert sizes.count() == 80 and sizes.agg(F.max("count")).first()[0] < 2 * (200 + 50)


def divergence_by_hand(rows, least=30, top=50):
    docs = [(r[2] or "", r[3] or "", [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r[1] or "")]) for r in rows]
    df, n = Counter(), Counter()
    for lang, source, words in docs:
        df.update({(lang, w) for w in words})
        n.update((lang, source, w) for w in words)
    groups = sorted({d[:2] for d in docs})
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(w for (x, w), k in df.items() if x == lang and k >= least)
        sources = [s for x, s in groups if x == lang]
        count = {s: {w: n[lang, s, w] for w in kept} for s in sources}
        total = {w: sum(count[s][w] for s in sources) for w in kept}
        share = lambda c: {w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept)) for w in kept}  # noqa: B023, E731
        p, q = {s: share(count[s]) for s in sources}, share(total)
        for s in sources:
            pairs = sorted((-sum(abs(p[s][w] - p[o][w]) for w in kept), o.encode()) for o in sources if o != s)
            terms = sorted((q[w] - p[s][w], w.encode()) for w in kept if count[s][w] and p[s][w] > q[w])[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item.decode(), -v, r) for r, (v, item) in enumerate(found, 1)]
    return sorted(out)


def divergence_rows(seed=6):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "élan", "straße", "a-b", "extraordinarily", "extraordinary", "extraordinarilyso", "exactly8", "中文", "x1y", "w" * 80, "w" * 81, "w" * 64, "İ", "É"] + [f"v{chr(97 + i)}" for i in range(26)]
    rows = []
    for i in range(700):
        words = [rng.choice(vocabulary[: 10 + i % 33]) for _ in range(rng.randrange(0, 12))]
        rows.append((i, rng.choice([" ", "\n", "_", "1"]).join(words), rng.choice(["en", "en", "de", None, ""]), rng.choice(["s0", "s0", "s1", "S1", "é", None]), 0))
    rows += [(800, None, "en", "empty", 0), (801, "123", "fr", "a", 0), (802, "rare", "fr", "b", 0), (803, "x" * 90_000 + " the", "en", "s0", 0), (None, "the the", "en", "s9", 0)]
    return rows + rows[:5]


@pytest.mark.parametrize("cfg", [divergence.DEFAULT, divergence.DivergenceConfig(shard_bytes=2000, term_block=5, source_block=2)])
def test_divergence_equals_brute_force(spark, cfg):
    rows = divergence_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert rows_of(divergence.source_divergence(df, cfg)) == divergence_by_hand(rows)


def test_divergence_on_awkward_tables(spark, awkward, nothing, clashing):
    assert divergence.source_divergence(nothing).count() == 0
    rows = [tuple(r) for r in awkward.collect()]
    expected = divergence_by_hand(rows)
    assert rows_of(divergence.source_divergence(awkward)) == expected
    extra = clashing.withColumns({c: F.lit("x") for c in ("term", "df", "sources", "counts", "block", "side", "low", "share", "vocabulary", "n", "value", "part", "item")})
    assert rows_of(divergence.source_divergence(extra)) == expected


def test_multikey_runs_part_all_words():
    rng = random.Random(2)
    words = [bytes(rng.choice(b"ab") for _ in range(rng.choice([1, 7, 8, 9, 16, 17, 70]))) for _ in range(3000)] + [b"z" * 200] * 3
    data = np.frombuffer(b" ".join(words) + b" " * 8, np.uint8)
    size = np.array([len(w) for w in words])
    start = np.cumsum(size + 1) - size - 1
    place, run = divergence.multikey_runs(data, start, size)
    assert sorted(place.tolist()) == list(range(len(words))) and (np.diff(run) >= 0).all()
    by_run = defaultdict(set)
    for i, r in zip(place.tolist(), run.tolist(), strict=True):
        by_run[r].add(words[i])
    assert all(len(s) == 1 for s in by_run.values()) and len(by_run) == len(set(words))
    none = np.zeros(0, np.int64)
    assert not len(divergence.multikey_runs(data, none, none)[0])
