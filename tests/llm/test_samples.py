"""Bounded samples that do not depend on how rows are dealt."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from varsight.llm import common


def _brute(rows, k, by=None):
    marked = rows.distinct().withColumn("m", F.xxhash64("doc_id")).collect()
    groups = {}
    for r in marked:
        groups.setdefault(r[by] if by else 0, []).append(r)
    return {(r["doc_id"], r["lang"]) for g in groups.values() for r in sorted(g, key=lambda r: (r["m"], r["doc_id"]))[:k]}


@pytest.mark.parametrize("by", [None, "lang"])
@pytest.mark.parametrize("parts", [8, 200])
def test_the_smallest_hashes_however_dealt(spark, monkeypatch, parts, by):
    """The rows that any later task can read are a small multiple of what was asked for, with many tasks as with few."""
    rows = spark.range(0, 60_000, 1, parts).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "en").when(F.col("id") < 20, "rare").otherwise("de").alias("lang"))
    kept = []
    write = common.materialize
    monkeypatch.setattr(common, "materialize", lambda df, label: kept.append(write(df, label)) or kept[-1])
    got = common.smallest(rows, 100, F.xxhash64("doc_id"), by)
    assert got.columns == ["doc_id", "lang"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == _brute(rows, 100, by)
    assert len(kept) == 1 and kept[0].count() < 100 * (6 if by else 3)


def test_repeated_rows_count_once(spark):
    """Nine in ten rows are one: the bound is raised until enough others lie below it."""
    hot = spark.range(0, 45_000, 1, 8).select(F.lit(7).cast("long").alias("doc_id"), F.lit("en").alias("lang"))
    rows = hot.unionByName(spark.range(0, 500, 1, 4).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang")))
    for by in (None, "lang"):
        found = {tuple(r) for r in common.smallest(rows, 200, F.xxhash64("doc_id"), by).collect()}
        assert found == _brute(rows, 200, by) and len(found) == 200


def test_few_rows_no_rows_and_clashing_names(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, "a", 6), (2, "a", 6)], "mark long, bound string, place int")
    for by in (None, "bound"):
        assert sorted(tuple(r) for r in common.smallest(rows, 10, F.xxhash64("mark"), by).collect()) == [(1, "a", 5), (2, "a", 6)]
        assert common.smallest(rows.limit(0), 10, F.xxhash64("mark"), by).collect() == []
