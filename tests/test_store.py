"""The store: commits that take effect at once, removals, concurrent and broken writes."""

from __future__ import annotations

import datetime as dt
import shutil
import threading

import pytest
from pyspark.sql import functions as F

from varsight.errors import CacheError
from varsight.sources import store

SPAN = (dt.date(2024, 1, 1), dt.date(2024, 1, 31))


def prices(spark, close, tickers=("AAA", "BBB")):
    rows = [(t, dt.date(2024, 1, d), close) for t in tickers for d in range(1, 32)]
    return spark.createDataFrame(rows, "ticker string, date date, close double")


def closes(df):
    return {(r["ticker"], r["close"]) for r in df.select("ticker", "close").distinct().collect()}


class Source:
    def __init__(self, spark, close):
        self.spark, self.close, self.asked = spark, close, 0

    def __call__(self):
        self.asked += 1
        return prices(self.spark, self.close)


def request(spark, root, read, tickers=("AAA", "BBB"), **more):
    return store.through_store(spark, root, "prices", list(tickers), *SPAN, read, **more)


def test_a_cleared_ticker_is_read_again(spark, tmp_path):
    root, read = str(tmp_path), Source(spark, 1.0)
    assert request(spark, root, read).count() == 62 and read.asked == 1
    assert store.clear_store(spark, root, "AAA") == 1
    assert closes(store.read_store(spark, root, "prices")) == {("BBB", 1.0)}
    read.close = 2.0
    assert closes(request(spark, root, read)) == {("AAA", 2.0), ("BBB", 1.0)} and read.asked == 2
    assert store.clear_store(spark, root) == 2 and store.clear_store(spark, root) == 0
    with pytest.raises(CacheError):
        store.read_store(spark, root, "prices")
    assert closes(request(spark, root, read)) == {("AAA", 2.0), ("BBB", 2.0)} and read.asked == 3


def test_a_ticker_whose_folder_is_gone_is_read_again(spark, tmp_path):
    root, read = str(tmp_path), Source(spark, 1.0)
    request(spark, root, read)
    (folder,) = tmp_path.glob("data/prices/generation=*/ticker=AAA")
    shutil.rmtree(folder)
    read.close = 2.0
    assert closes(request(spark, root, read)) == {("AAA", 2.0), ("BBB", 1.0)}


@pytest.mark.parametrize("broken", ["_write_lines", "_commit"])
def test_a_write_that_breaks_off_shows_the_old_state(spark, tmp_path, monkeypatch, broken):
    root = str(tmp_path)
    store.write_store(prices(spark, 1.0), root, "prices")
    before = closes(store.read_store(spark, root, "prices"))

    def crash(*a, **k):
        raise OSError("the machine went down")

    with monkeypatch.context() as patch:
        patch.setattr(store, broken, crash)
        with pytest.raises(OSError):
            store.write_store(prices(spark, 2.0), root, "prices")
    assert closes(store.read_store(spark, root, "prices")) == before
    assert store.read_manifest(spark, root).count() == 2
    store.write_store(prices(spark, 3.0, ["BBB"]), root, "prices")
    assert closes(store.read_store(spark, root, "prices")) == {("AAA", 1.0), ("BBB", 3.0)}
    assert store.vacuum_store(spark, root, older_than_hours=1000) == 0
    assert store.vacuum_store(spark, root, older_than_hours=0) >= 2
    assert closes(store.read_store(spark, root, "prices")) == {("AAA", 1.0), ("BBB", 3.0)}
    assert len(list(tmp_path.glob("data/prices/generation=*"))) == 2


def test_a_store_that_cannot_be_written_is_passed_by(spark, tmp_path, monkeypatch):
    root, read = str(tmp_path), Source(spark, 1.0)
    request(spark, root, read, ["AAA"])
    read.close = 2.0
    monkeypatch.setattr(store, "_commit", lambda *a, **k: (_ for _ in ()).throw(OSError("full")))
    assert closes(request(spark, root, read)) == {("AAA", 1.0), ("BBB", 2.0)}


def test_writers_at_once_all_survive(spark, tmp_path):
    root = str(tmp_path)
    tickers = [f"T{k}" for k in range(6)]
    start = threading.Barrier(len(tickers))

    def write(k, t):
        df = prices(spark, float(k), [t])
        start.wait()
        store.write_store(df, root, "prices")

    workers = [threading.Thread(target=write, args=(k, t)) for k, t in enumerate(tickers)]
    for w in workers:
        w.start()
    for w in workers:
        w.join()
    assert closes(store.read_store(spark, root, "prices")) == {(t, float(k)) for k, t in enumerate(tickers)}
    assert [c["version"] for c in store._log(spark, root)] == list(range(1, 7))


def test_a_version_is_made_once(spark, tmp_path):
    files, name = store._Files(spark, str(tmp_path)), str(tmp_path / "log" / "1.json")
    done = []
    workers = [threading.Thread(target=lambda k=k: done.append((files.create_once(name, str(k)), k))) for k in range(8)]
    for w in workers:
        w.start()
    for w in workers:
        w.join()
    (winner,) = [k for made, k in done if made]
    assert (tmp_path / "log" / "1.json").read_text() == str(winner) and len(done) == 8
    assert not list((tmp_path / "log").glob("*.tmp"))


def test_vacuum_waits_for_a_commit_between(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    store.write_store(prices(spark, 1.0), root, "prices")
    real, tried = store._commit, []

    def commit(spark, root, name, after=None, whole=False):
        if whole and not tried:
            tried.append(1)
            store.write_store(prices(spark, 2.0, ["AAA"]), root, "prices")
        return real(spark, root, name, after, whole)

    monkeypatch.setattr(store, "_commit", commit)
    store.vacuum_store(spark, root, older_than_hours=0)
    assert closes(store.read_store(spark, root, "prices")) == {("AAA", 2.0), ("BBB", 1.0)}
    assert len(store._log(spark, root)) == 1
    store.write_store(prices(spark, 3.0, ["CCC"]), root, "prices")
    assert store.clear_store(spark, root, "AAA") == 1
    assert closes(store.read_store(spark, root, "prices")) == {("BBB", 1.0), ("CCC", 3.0)}


@pytest.mark.parametrize("zone", ["America/Los_Angeles", "Asia/Tokyo"])
def test_the_time_of_a_fetch_does_not_depend_on_the_zone(spark, tmp_path, zone):
    root, read = str(tmp_path), Source(spark, 1.0)
    noon = dt.datetime(2024, 1, 31, 12, tzinfo=dt.UTC)
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        store.write_store(prices(spark, 1.0), root, "prices", fetched_at=noon, covers=SPAN)
        for zone_of_reader in (zone, "UTC"):
            spark.conf.set("spark.sql.session.timeZone", zone_of_reader)
            line = store._known_lines(spark, root, "prices", ["AAA"])["AAA"]
            assert line["fetched_at"] == noon
            request(spark, root, read, now=noon + dt.timedelta(minutes=59), ttl_hours=1)
            assert read.asked == 0
        request(spark, root, read, now=noon + dt.timedelta(minutes=61), ttl_hours=1)
        assert read.asked == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_tickers_that_look_like_numbers_or_paths(spark, tmp_path):
    root, names = str(tmp_path), ["007", "7", "BRK.B", "A/B", "2024-01-01"]
    read = lambda: prices(spark, 1.0, names)
    request(spark, root, read, names)
    assert closes(request(spark, root, lambda: 1 / 0, names)) == {(t, 1.0) for t in names}
    assert store.clear_store(spark, root, "7") == 1
    assert store.read_store(spark, root, "prices", ["007", "7"]).agg(F.min("ticker"), F.max("ticker")).first()[:] == ("007", "007")
