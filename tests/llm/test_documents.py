"""Fingerprints, archives, licenses, the pipeline and the registry."""

from __future__ import annotations

import base64
import gzip
import hashlib
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import SCHEMA, awkward_rows, prose
from varsight.llm import fingerprints, licenses, queries, warc
from varsight.llm.license_texts import templates as known_templates


SF = Path("/root/testdata/sf0.001")


def bag(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return Counter([tuple(w)] if 0 < len(w) < width else [tuple(w[i : i + width]) for i in range(len(w) - width + 1)])


def jaccard(a, b):
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 1.0


def test_fingerprints_follow_the_next_document(spark):
    rng = random.Random(2)
    ids = rng.sample(range(10**9), 300)
    texts = {d: prose(rng, rng.randrange(0, 120), 50) for d in ids}
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in texts.items()], SCHEMA).repartition(5)
    out = {r["doc_id"]: r for r in fingerprints.compare_edited(df).collect()}
    order = sorted(ids)
    assert sorted(out) == order
    errors = []
    for k, d in enumerate(order):
        text, after = texts[d], texts[order[(k + 1) % len(order)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert out[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and out[d]["n_chars"] == len(text)
        assert (text == edited) <= (out[d]["near_edited"] == 1)
        errors.append(out[d]["near_edited"] - jaccard(bag(text), bag(edited)))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.08


def test_sampling_is_generalised_jaccard():
    """With weights, the share of equal samples estimates sum of minima by sum of maxima."""
    rng = random.Random(4)
    a = " ".join("abcdefghij"[rng.randrange(4)] for _ in range(300))
    b = " ".join("abcdefghij"[rng.randrange(5)] for _ in range(300))
    cfg = fingerprints.FingerprintConfig(samples=4096, width=1)
    s, some = fingerprints.signatures([a, b, a, ""], cfg)
    assert (s[0] == s[2]).all() and not some[3]
    assert (s[0] == s[1]).mean() == pytest.approx(jaccard(bag(a, 1), bag(b, 1)), abs=0.035)


def test_fingerprint_ranges(spark):
    """The next document is found over any number of ranges, one row a range and a large group of null ids among them."""
    rng = random.Random(8)
    rows = [(None, f"a b c d e f{i % 90}") for i in range(300)] + [(i * i - 50, " ".join(rng.choices("abcdefgh", k=rng.randrange(12)))) for i in range(40)]
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], SCHEMA).repartition(4)
    edits = {}
    for chars in (3, 60, 1 << 20):
        found = fingerprints.compare_edited(df, fingerprints.FingerprintConfig(range_chars=chars)).collect()
        edits[chars] = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["edited_sha256"], r["near_next"]) for r in found)
    assert edits[3] == edits[60] == edits[1 << 20] and len(edits[3]) == 340
    known = sorted((d, t) for d, t in rows if d is not None)
    for (doc_id, text), (_, after) in zip(known, known[1:]):
        half = len(text) // 2
        assert (True, doc_id, hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()) in {e[:3] for e in edits[3]}


def test_fingerprints_awkward(awkward, clashing, nothing, spark):
    rows = fingerprints.compare_edited(awkward).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in awkward_rows())
    prints = {}
    for r in fingerprints.fingerprint(clashing).select("text", "fingerprint").collect():
        assert prints.setdefault(r["text"] or "", r["fingerprint"]) == r["fingerprint"]
    assert prints[""] == "" and len(prints["one two"]) == 256
    assert fingerprints.compare_edited(nothing).count() == 0
    lone = fingerprints.compare_edited(spark.createDataFrame([(1, "a b c d e f g h", "en", "s", 15)], SCHEMA)).collect()
    assert len(lone) == 1 and lone[0]["near_next"] == 1


def pages():
    rng = random.Random(8)
    odd = ["", None, "<p>é 中</p>", "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n", "\r\n", "x" * 200_000, "tail\n", " "]
    rows = [(i, f"http://Host{i % 7}.example.com:80/p/{i}?q={i % 3}", rng.choice(odd + [f"<h1>{i}</h1>"] * 4)) for i in range(200)]
    return [*rows, (500, None, "<p>é 中</p>"), (501, "not a url\r\nX-Injected: 1", "once"), (None, "http://a.b/", "once"), (200, "http://a.b/", "lone"), (200, "http://a.b/", "lone"), (201, "http://a.b/c", "lone")]


def expected(rows, least=0):
    first = {}
    for i, _, h in rows:
        h = (h or "").encode()
        if i is not None:
            first[h] = min(first.get(h, i), i)
    out = Counter()
    for i, _, h in rows:
        h = (h or "").encode()
        again = len(h) >= least and h in first and first[h] != i
        out[i, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "revisit" if again else "response", first[h] if again else None] += 1
    return out


@pytest.mark.parametrize("least", [0, 5])
def test_archives(spark, least):
    df = spark.createDataFrame([(*r, "x") for r in pages()], "page_id long, url string, html string, digest string").repartition(3)
    captures = warc.archive_pages(df, warc.WarcConfig(least_payload=least, archive_bytes=4000))
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in captures.collect())
    assert got == expected(pages(), least)
    keys = [(r["url_key"], r["captured"], -1 if r["page_id"] is None else r["page_id"]) for r in captures.collect()]
    assert keys == sorted(keys)
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_archives_by_offset_and_in_many_ranges(spark):
    """A seek to a record's offset yields the record; ranges of a few captures give the same order; archives end at their bound."""
    rng = random.Random(3)
    rows = [(i, f"http://h{rng.randrange(4)}.example/{rng.randrange(30)}", f"<p>{rng.random()}</p>" * 20) for i in range(600)] + [(900, "http://h1.example/1", None)] * 40
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    cfg = warc.WarcConfig(archive_bytes=3000, merge_rows=50)
    captures = warc.archive_pages(df, cfg)
    assert captures.rdd.getNumPartitions() == 13
    found = captures.collect()
    order = [(r["url_key"], r["captured"], r["page_id"], r["archive"], r["record_offset"]) for r in found]
    assert order == sorted(order) and len(order) == len(set(order)) == 640
    assert len({r["archive"] for r in found}) > 8
    for r in found[::37]:
        data = open(r["archive"].removeprefix("file:"), "rb").read()
        assert len(data) < 3000 + 2000
        unzip = zlib.decompressobj(wbits=31)
        head = unzip.decompress(data[r["record_offset"] :]).decode().split("\r\n")
        assert unzip.eof and f"WARC-Record-ID: <urn:capture:{r['page_id']}>" in head and f"WARC-Payload-Digest: sha1:{r['payload_digest']}" in head


def test_large_records_and_torn_archives():
    """A record whose length does not end in a zero byte is followed by an empty member; torn archives are refused."""
    big = warc.record_bytes(1, "http://a.b/", "x" * (17 << 20), 17 << 20, warc.payload_digest(b"x" * (17 << 20)), None, False, warc.DEFAULT)
    packed = warc._member(big)
    assert packed.endswith(b"\0") and gzip.decompress(packed) == big
    small = warc._member(warc.record_bytes(2, None, None, 0, warc.payload_digest(b""), 1, True, warc.DEFAULT))
    heads = [(h["warc-type"], at) for h, at, _ in warc.parse_records(packed + small)]
    assert heads == [("response", 0), ("revisit", len(packed))]
    with pytest.raises(ValueError):
        list(warc.parse_records((packed + small)[:-9]))


def test_url_keys():
    assert warc.url_key("http://www.Example.com:80/A?B=1") == "com,example)/a?b=1"
    assert warc.url_key("https://x.org:8443/") == "org,x:8443)/" and warc.url_key(None) == ")/"


def test_loser_tree():
    rng = random.Random(0)
    for k in range(0, 12):
        runs = [sorted(((rng.randrange(9),) for _ in range(rng.randrange(6)))) for _ in range(k)]
        assert list(warc.LoserTree(runs, key=lambda r: r)) == sorted(x for r in runs for x in r)


def test_many_runs_are_merged_a_few_at_a_time(monkeypatch):
    """2,000 runs, some of one row and some empty, with at most 64 open."""
    rng = random.Random(3)
    runs = [sorted((rng.randrange(5_000),) for _ in range(rng.choice([0, 1, 1, 2, 9]))) for _ in range(2_000)]
    opened, plain = [], warc.LoserTree.__init__
    monkeypatch.setattr(warc.LoserTree, "__init__", lambda self, some, key=warc._order: (opened.append(len(some)), plain(self, some, key))[1])
    assert list(warc.merge_runs(runs, 64, key=lambda r: r)) == sorted(x for r in runs for x in r)
    assert max(opened) <= 64 and len(opened) == 33


def test_runs_of_many_archives(spark, tmp_path):
    """Archives of a task become longer runs; the index is that of one archive, whatever the bounds."""
    pages = [(i, f"http://h{i % 7}.org/p{i % 31}", f"<p>{i % 40}</p>" * 30) for i in range(400)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
    rows = {}
    for name, cfg in {"few": warc.WarcConfig(archive_bytes=900, merge_rows=60, fan_in=2), "one": warc.WarcConfig()}.items():
        found = warc.archive_pages(df, cfg).collect()
        rows[name] = [(r["url_key"], r["captured"], r["page_id"], r["record_type"], r["refers_to"], r["payload_digest"]) for r in found]
    assert rows["few"] == rows["one"] and len(rows["one"]) == 400


def notices():
    """Wordings and the names that each belongs to; one wording may stand for several."""
    out = {}
    for name, texts in known_templates().items():
        for text in texts:
            out.setdefault(" ".join(re.findall(r"[a-z0-9]+", text.lower())), (text, set()))[1].add(name)
    return list(out.values())


def test_licenses(spark, awkward, clashing, nothing):
    """Every wording is found in running text, in other case and wrapping, and where it lies."""
    rng = random.Random(6)
    texts, want = [], []
    for notice, names in notices():
        body = prose(rng, 40) + "\n" + notice + "\n" + prose(rng, 40)
        texts += [body, body.upper().replace(" ", "\n  ")]
        want += [names, names]
    texts += [prose(rng, 100), "the License of the software, the terms of use and of the public", notices()[0][0] + " " + prose(rng, 30) + " " + notices()[0][0]]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: r for r in licenses.scan_licenses(df).collect()}
    for i, names in enumerate(want):
        assert set(got[i]["licenses"].split(",")) & names, texts[i][200:300]
        first = int(got[i]["spans"].split(":")[1])
        assert 38 <= first <= 44 or got[i]["n_matches"] > 1, got[i]
    n = len(want)
    assert got[n]["licenses"] == got[n + 1]["licenses"] == "" and got[n + 2]["n_matches"] == 2
    assert licenses.scan_licenses(awkward).count() == licenses.scan_licenses(clashing).count() == len(awkward_rows())
    assert licenses.scan_licenses(nothing).count() == 0
    assert licenses.scan_licenses(awkward, templates={}).where("n_matches > 0").count() == 0
    assert licenses.scan_licenses(awkward, templates={"none": ["", " . "]}).where("n_matches > 0").count() == 0
    cfg = licenses.DEFAULT
    assert 1 - (1 - cfg.similarity**cfg.rows) ** licenses.bands_for(cfg) >= cfg.recall


def scanned(spark, lines):
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(lines)], SCHEMA)
    return [r["licenses"] for r in licenses.scan_licenses(df).orderBy("doc_id").collect()]


def test_license_names_and_versions_are_whole(spark):
    lines = {
        "This work is licensed under the Creative Commons Attribution 2.0 International License": "unknown",
        "This work is licensed under the GNU Free Documentation License, version 1.3": "unknown",
        "This work is licensed under the Open Database License": "unknown",
        "this work is licensed under the company handbook": "",
        "This work is licensed under the GNU General Public License": "unknown",
        "Licensed under the GNU General Public License, version 4": "unknown",
        "This work is licensed under the Mozilla Public License": "unknown",
        "SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
        "SPDX-License-Identifier: GPL-2.0-only": "GPL-2.0",
        "Licensed under the Apache License, Version 2.0": "Apache-2.0",
        "Licensed under the Apache License, Version 2.0.1": "unknown",
        "Licensed under the Apache License, Version 1.1": "unknown",
        "Released under GPLv2": "GPL-2.0",
        "Released under GPLv3.": "GPL-3.0",
        "Released under LGPLv3": "LGPL-3.0",
        "Released under GPLv9": "unknown",
        "licensed under the GNU General Public License v3.0 and nothing else": "GPL-3.0",
        "licensed under the GNU Lesser General Public License, version 2.1": "LGPL-2.1",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 7 of the License.": "",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License.": "GPL-2.0",
        "licensed under CC BY 4.0": "CC-BY-4.0",
        "licensed under CC BY-SA 4.0": "CC-BY-SA-4.0",
        "licensed under CC BY 2.5": "unknown",
    }
    found = dict(zip(lines, scanned(spark, lines), strict=True))
    assert found == lines


HARMLESS = [
    "company handbook", "old rules of the harbour", "name of the family", "law of the land", "terms we agreed on yesterday", "Liquor License Act", "Medical License Board", "supervision of a doctor", "bridge at noon", "same roof as before",
    "new mayor", "general public's eye", "public health code", "version of events he gave", "mit of a boxer", "apache helicopters of the army", "creative direction of the founder", "common land rules", "eclipse of 1999", "boost it gave",
    "gnu and the zebra", "free market rules", "software engineer's watch", "mozilla team's eyes", "attribution of the poem", "zero tolerance policy", "two clause treaty of 1907", "three clause contract with him", "driving license she held", "fishing license of the county",
]


def test_harmless_lines_hold_no_license(spark):
    lines = [f"The house was {verb} under the {rest}" for rest in HARMLESS for verb in ("licensed", "released")]
    assert len(lines) == 60 and set(scanned(spark, lines)) == {""}


def test_licenses_against_brute_force():
    """On edited notices the bands retrieve what an exhaustive check of all windows and templates accepts."""
    rng = random.Random(12)
    cfg = licenses.DEFAULT
    index = licenses.TemplateIndex(known_templates(), cfg)
    accepted = lost = 0
    long = [text for text, _ in notices() if len(text.split()) > 12]
    for _ in range(150):
        words = rng.choice(long).split()[:120]
        for _ in range(rng.randrange(0, 1 + len(words) // 7)):
            at = rng.randrange(len(words))
            words[at : at + rng.randrange(2)] = [f"edit{rng.randrange(99)}"]
        raw = np.frombuffer((prose(rng, 30) + " " + " ".join(words) + " " + prose(rng, 30)).encode(), dtype=np.uint8)
        hashes, ranges = licenses.tk.word_hashes(licenses._normal(raw), np.array([0, len(raw)]))
        shingles, _ = licenses.tk.shingle_hashes(hashes, ranges, cfg.width)
        for span, members, least, tables in index.classes:
            size, step = span + max(span // 2, 2), max(span // 4, 1)
            for s in range(0, len(shingles), step):
                window = shingles[s : s + size]
                known = set(window.tolist())
                hold = {i for i in members if len(known & set(index.sets[i].tolist())) >= cfg.containment * len(index.sets[i])}
                if hold:
                    assert np.isin(window, index.known).sum() >= least
                    accepted += len(hold)
                    lost += len(hold - index.retrieved(window, tables))
    assert accepted > 300 and lost <= 0.005 * accepted


@pytest.mark.skipif(not SF.exists(), reason="the driver's tables are absent")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, str(SF))
    want = con.execute(queries.oracle_sql()[name]).fetchall()
    columns = [c[0] for c in con.description]
    assert sorted(columns) == sorted(got.columns)
    assert Counter(tuple(r) for r in got.select(*columns).collect()) == Counter(want)


def test_registry():
    names = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries())
    assert names == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "ngram_jaccard_join", "secret_scans", "best_fit_packing"]


def test_pipeline_stages(spark, awkward, nothing, tmp_path):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for start in (awkward, nothing):
        docs = start
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            before = docs.count()
            docs = stage(spark, docs, str(tmp_path)).cache()
            if k < 4:
                assert docs.columns == start.columns and docs.count() <= before
    awkward.write.parquet(str(tmp_path / "documents.parquet"))
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert packed.where(F.col("doc_id").isin(2, 3)).count() == 0 and packed.where("doc_id = 1").count() == 1
