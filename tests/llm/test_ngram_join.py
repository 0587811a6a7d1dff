from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.conftest import SCHEMA, awkward_rows, prose, shingles, words_of
from varsight.llm import graph
from varsight.llm import ngram_join as nj


def brute(rows):
    """doc row index to (n_shingles, smallest id of its component) by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    holders = defaultdict(list)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        seen = Counter(j for g in s for j in holders[g])
        for j, o in seen.items():
            if 100 * o >= 75 * (len(s) + len(sets[j]) - o):
                parent[find(i)] = find(j)
        for g in s:
            holders[g].append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return Counter((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows))


def run(df, cfg=nj.DEFAULT):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in nj.ngram_components(df, cfg).collect())


def test_awkward_rows(awkward, clashing):
    want = brute([(r[0], r[1]) for r in awkward_rows()])
    assert run(awkward) == want
    assert run(clashing) == want


def test_empty_table(nothing):
    assert run(nothing) == Counter()
    assert nj.keep_first(nothing).count() == 0


@pytest.mark.parametrize("tile", [1024, 8])
def test_families_and_tiles(spark, tile):
    """Chains of edits, passages in common and, with tiny tiles, families over several tiles."""
    rng = random.Random(3)
    passage = prose(rng, 60)
    rows, k = [], 0
    for _family in range(6):
        w = words_of(prose(rng, 150, 4000))
        for _ in range(30):
            w = list(w)
            for _ in range(rng.randrange(0, 5)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
            text = " ".join(w)
            rows.append((k, text if rng.random() < 0.7 else text[: len(text) // 2] + " " + passage))
            k += 1
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], SCHEMA).repartition(4)
    assert run(df, nj.JoinConfig(tile_docs=tile, hubs=2)) == brute(rows)


def test_tasks_stay_small_where_a_family_hardly_links(spark, monkeypatch):
    """Documents with a passage in common and too little else: no task holds the whole family."""
    rng = random.Random(8)
    passage = prose(rng, 64)
    rows = [(i, passage + " " + " ".join(f"own{i}n{k}" for k in range(15))) for i in range(240)]
    rows += [(1000 + i, rows[i][1] + " end") for i in range(0, 240, 40)]
    most, links = [], nj._links

    def watched(members, sets, percent):
        most.append(max(r["count"] for r in members.select("family", "tile", "class_id").distinct().groupBy("family", "tile").count().collect()))
        return links(members, sets, percent)

    monkeypatch.setattr(nj, "_links", watched)
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], SCHEMA).repartition(3)
    assert run(df, nj.JoinConfig(tile_docs=16, hubs=4)) == brute(rows)
    assert len(most) == 2 and max(most) <= 80


def test_chain_of_unlinked_documents(spark, monkeypatch):
    """Texts cut from one long text, each half of the next: one family without a link, whose tasks stay bounded."""
    n, tile = 4000, 256
    rng = random.Random(2)
    words = [f"w{rng.randrange(10**9)}" for _ in range(50 * (n + 1))]
    df = spark.createDataFrame([(i, " ".join(words[50 * i : 50 * i + 100]), "en", "s", 1) for i in range(n)], SCHEMA).repartition(8)
    most, links = [], nj._links

    def watched(members, sets, percent):
        most.append(members.groupBy("family", "tile").count().agg({"count": "max"}).first()[0])
        return links(members, sets, percent)

    monkeypatch.setattr(nj, "_links", watched)
    assert all(c == d and s == 96 for d, s, c in run(df, nj.JoinConfig(tile_docs=tile)))
    assert len(most) == 2 and max(most) <= 2 * (1.3 * tile) + nj.DEFAULT.hubs


def test_hubs_are_dealt(spark):
    """A star of many leaves, whose edges go to several tasks, has the components of the plain way."""
    rng = random.Random(5)
    edges = [(5000, i) for i in range(3000)] + [(5001 + i, rng.randrange(3000)) for i in range(500)] + [(9000, 9001), (9000, 9001)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(6)
    cfg = graph.GraphConfig(hub_rows=50, hub_parts=7)
    got = {r["node"]: r["component"] for r in graph.connected_components(df, cfg).collect()}
    assert got == {r["node"]: r["component"] for r in graph.connected_components(df).collect()}
    assert set(got) == {x for e in edges for x in e} and got[9001] == 9000 and {c for x, c in got.items() if x < 6000} == {0}
    assert graph._hubs(df, cfg)[1] == [(5000, 0)]


def test_repeated_keys_of_many_rows():
    """Rows that repeat are left out however many classes hold a key, also across batches."""
    classes = np.repeat(np.arange(3 * nj._MANY), 2)
    keys = np.full(len(classes), 7, dtype=np.int64)
    cut = [0, 3000, 9001, 9002, len(keys)]
    batches = [nj.pa.RecordBatch.from_arrays([nj.pa.array(keys[a:b]), nj.pa.array(classes[a:b])], ["key", "class_id"]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    told = np.concatenate([b.column(0).to_numpy() for b in nj._repeated_keys(iter(batches))])
    assert np.array_equal(told, np.arange(3 * nj._MANY))


def test_keep_first(awkward):
    kept = nj.keep_first(awkward)
    assert kept.columns == awkward.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    groups = brute([(r[0], r[1]) for r in awkward_rows()])
    heads = {c for (_, n, c) in groups if n}
    assert all(ids[h] == 1 for h in heads)
    assert ids[4] == 1 and ids[5] == 1 and ids[6] == 1  # without words: all stay
    assert ids[2] == 0 and ids[3] == 0


def test_keep_first_keeps_columns(clashing):
    named = clashing.withColumn("row_number", clashing["lane"])
    kept = nj.keep_first(named)
    assert kept.columns == named.columns and [r[0] for r in kept.select("row_number").distinct().collect()] == ["x"]


def test_tree_never_prunes_a_link():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 2**63, size=n, dtype=np.uint64)) for n in rng.integers(5, 60, size=300)]
    sets += [np.unique(np.concatenate([s[2:], rng.integers(0, 2**63, size=2, dtype=np.uint64)])) for s in sets[:150]]
    points = np.stack([np.bincount((s >> np.uint64(58)).astype(int), minlength=nj.GROUPS) for s in sets])
    sizes = np.array([len(s) for s in sets])
    tree = nj.CountVectorTree(points, sizes)
    for i, s in enumerate(sets):
        near = set(tree.search(points[i], sizes[i], 75).tolist())
        for j, t in enumerate(sets):
            o = len(np.intersect1d(s, t))
            if 100 * o >= 75 * (len(s) + len(t) - o):
                assert j in near


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(200)] + [(500 + rng.randrange(50), 500 + rng.randrange(50)) for _ in range(40)] + [(7, None), (9, 9)]
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {n: find(n) for n in parent}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_settled_edges_take_no_round(spark, monkeypatch):
    """Stars around their smallest nodes are told as such; a path is not."""
    stars = spark.createDataFrame([(0, i) for i in range(1, 9)] + [(20, 21), (20, 21)], "a long, b long")
    written = []
    write = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, label: written.append(label) or write(df, label))
    got = sorted(tuple(r) for r in graph.connected_components(stars).collect())
    assert got == [(i, 0) for i in range(9)] + [(20, 20), (21, 20)] and len(written) == 1
    got = sorted(tuple(r) for r in graph.connected_components(spark.createDataFrame([(3, 2), (2, 1)], "a long, b long")).collect())
    assert got == [(1, 1), (2, 1), (3, 1)]


def test_further_links_merge_components(spark):
    """Links between components, of classes that had none, and within a component, as from all links at once."""
    schema = "a long, b long"
    first = [(5, 1), (6, 5), (9, 8), (12, 11)]
    for second in ([], [(6, 5)], [(9, 6), (20, 12), (31, 30), (6, 1)], [(-3, 9), (9, 12)]):
        joined = graph.connected_components(spark.createDataFrame(first, schema))
        got = sorted(tuple(r) for r in nj._merged(joined, spark.createDataFrame(second, schema), nj.DEFAULT).collect())
        assert got == sorted(tuple(r) for r in graph.connected_components(spark.createDataFrame(first + second, schema)).collect())
