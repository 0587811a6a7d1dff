"""Readers, the store, streaming bars and the command line."""

from __future__ import annotations

import datetime as dt
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.conftest import sample_history
from varsight import cli
from varsight.errors import BacktestError, InsufficientDataError, MissingEventsError, SchemaError, SourceError
from varsight.sources import store, tables
from varsight.streaming import bars as streaming


@pytest.fixture()
def files(tmp_path):
    bars, dates = sample_history()
    bars.to_csv(tmp_path / "prices.csv", index=False)
    (tmp_path / "events.csv").write_text("Ticker, Announcement_Date ,note\n" + "".join(f"syn,{d},x\n" for d in dates) + "syn,not a date,x\n")
    return tmp_path


def test_csv_readers(spark, files):
    raw = tables.read_price_csv(spark, str(files / "prices.csv"))
    bars = tables.load_prices(raw, ["syn"], dt.date(2023, 2, 1), dt.date(2024, 2, 1))
    span = bars.agg(F.min("date"), F.max("date")).first()
    assert tuple(span) == (dt.date(2023, 2, 1), dt.date(2024, 2, 1))
    assert tables.read_event_csv(spark, str(files / "events.csv")).count() == 7
    with pytest.raises(InsufficientDataError):
        tables.load_prices(raw, end=dt.date(2023, 1, 20))
    with pytest.raises(SourceError):
        tables.load_prices(raw, ["NONE"])
    with pytest.raises(SchemaError):
        tables.read_event_csv(spark, str(files / "events.csv"), column="absent")
    (files / "empty.csv").write_text("date\nnothing\n")
    with pytest.raises(MissingEventsError):
        tables.read_event_csv(spark, str(files / "empty.csv"), ticker="A")


def test_universe_and_events(spark, tmp_path):
    (tmp_path / "u.csv").write_text("name,Symbol\nx, bbb\ny,aaa\nz,BBB\nw,\n")
    assert tables.read_universe(spark, str(tmp_path / "u.csv")) == ["BBB", "AAA"]
    rows = spark.createDataFrame([("A", dt.date(2024, 1, d)) for d in (1, 1, 2, 3)], "ticker string, announcement_date date")
    assert tables.load_events(rows, asof=dt.date(2024, 1, 3)).count() == 2
    assert tables.load_events(rows, include_future=True, limit=1).first()["announcement_date"] == dt.date(2024, 1, 3)
    start, end = tables.default_range(7, dt.date(2024, 1, 1))
    assert (end - start).days == 2557


def test_store(spark, tmp_path, sample):
    root = str(tmp_path / "store")
    store.write_store(sample[0], root, "prices", fetched_at=dt.datetime(2025, 1, 1))
    store.write_store(sample[0].withColumn("ticker", F.lit("BRK.B")), root, "prices")
    store.write_store(sample[1], root, "events")
    part = store.read_store(spark, root, "prices", ["SYN"], dt.date(2023, 3, 1), dt.date(2023, 3, 31))
    assert part.count() == 23
    assert "PartitionFilters: [isnotnull(ticker" in part._jdf.queryExecution().executedPlan().toString()
    line = store.read_manifest(spark, root).where("ticker = 'SYN' and kind = 'prices'").first().asDict()
    assert line["rows"] == 521
    ask = (dt.date(2023, 2, 1), dt.date(2024, 6, 1))
    assert store.is_fresh(line, *ask) and not store.is_fresh(line, *ask, auto_adjust=False)
    assert not store.is_fresh(line, dt.date(2020, 1, 1), ask[1])
    recent = line | {"end": dt.date.today(), "fetched_at": dt.datetime.now()}
    assert store.is_fresh(recent, *ask, now=dt.datetime.now()) and not store.is_fresh(recent | {"fetched_at": dt.datetime(2020, 1, 1)}, *ask)
    assert store.clear_store(spark, root, "BRK.B") == 1 and store.read_store(spark, root, "prices").select("ticker").distinct().count() == 1
    assert store.clear_store(spark, str(tmp_path / "nowhere")) == 0


def test_through_store(spark, tmp_path, sample):
    """A store is read where it is fresh and filled from the source where it is not."""
    root, asked = str(tmp_path / "store"), []

    def read():
        asked.append(1)
        return sample[0]

    span = (dt.date(2023, 2, 1), dt.date(2024, 6, 28))
    first = store.through_store(spark, root, "prices", ["SYN"], *span, read)
    again = store.through_store(spark, root, "prices", ["SYN"], *span, read)
    assert len(asked) == 1 and first.count() == again.count() > 300
    assert first.agg(F.min("date")).first()[0] >= span[0]
    store.through_store(spark, root, "prices", ["SYN"], *span, read, force_refresh=True)
    store.through_store(spark, root, "prices", ["SYN"], *span, read, auto_adjust=False)
    store.through_store(spark, root, "prices", ["SYN"], dt.date(2020, 1, 1), span[1], read)
    assert len(asked) == 4
    recent = (span[0], dt.date.today())
    for hours, reads in ((24, 5), (24, 5), (0, 6)):
        store.through_store(spark, root, "prices", ["SYN"], *recent, read, ttl_hours=hours)
        assert len(asked) == reads


def test_stamps_count_by_their_utc_day(spark):
    rows = spark.createDataFrame([("A", "2024-01-01 22:30:00-05:00"), ("A", "2024-01-03"), ("A", "no date")], "ticker string, announcement_date string")
    found = {r["announcement_date"] for r in tables.load_events(rows, include_future=True).collect()}
    assert found == {dt.date(2024, 1, 2), dt.date(2024, 1, 3)}


def test_streaming_matches_batch(spark, tmp_path):
    rows = [("A", dt.datetime(2024, 1, 1, h, m), float(h * 60 + m)) for h in range(3) for m in (1, 30, 59)]
    ticks = spark.createDataFrame(rows, "ticker string, ts timestamp, price double")
    ticks.write.parquet(str(tmp_path / "ticks"))
    stream = spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "ticks"))
    query = streaming.windowed_bars(stream, lateness="10 minutes").writeStream.outputMode("append").format("memory").queryName("hourly").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    closed = spark.table("hourly").orderBy("bar_start").collect()
    batch = streaming.windowed_bars(ticks).orderBy("bar_start").collect()
    assert closed == batch[:2] and batch[0]["open"] == 1.0 and batch[0]["n_ticks"] == 3


def test_command_line(spark, files, capsys):
    out = files / "out"
    args = ["-t", "SYN", "--prices-csv", str(files / "prices.csv"), "--earnings-csv", str(files / "events.csv"), "--outdir", str(out), "--save-csv", "--plot"]
    assert cli.main(args) == 0
    said = capsys.readouterr().out
    assert "SYN: 7 events" in said and "53.35%" in said and "8.13%" in said and "events: 7 aligned" in said and "implied moves: historical_proxy" in said
    assert list(out.glob("events/ticker=SYN/*.csv")) and list(out.glob("trades/ticker=SYN/*.csv"))
    stages = [json.loads(x) for p in Path(out).glob("stages/*.json") for x in p.read_text().splitlines()]
    assert stages == [{"ticker": "SYN", "stages": {"decomposition": "ok", "vrp": "ok", "backtest": "ok"}}]
    assert list(out.glob("charts/cone/*.parquet"))


def test_command_line_failures(spark, files, capsys):
    prices, events = str(files / "prices.csv"), str(files / "events.csv")
    assert cli.main(["-t", "SYN", "--prices-csv", prices]) == 2
    assert cli.main([]) == 2
    assert cli.main(["-t", "SYN", "GONE", "--prices-csv", prices, "--earnings-csv", events, "-q"]) == 1
    assert cli.main(["-t", "SYN", "--prices-csv", prices, "--earnings-csv", events, "--event-window", "0", "-q"]) == 2
    for wrong in (["--estimator", "x"], ["--backend", "plotly"]):
        with pytest.raises(SystemExit) as stop:
            cli.main(wrong)
        assert stop.value.code == 2
    with pytest.raises(SystemExit) as stop:
        cli.main(["--version"])
    assert stop.value.code == 0 and "varsight" in capsys.readouterr().out


def test_stages_are_written_when_a_backtest_cannot_run(spark, files):
    out = files / "out"
    args = ["-t", "SYN", "--prices-csv", str(files / "prices.csv"), "--earnings-csv", str(files / "events.csv"), "--outdir", str(out), "--save-csv", "-q"]
    assert cli.main([*args, "--exit-offset", "3"]) == 1  # the front leg would expire before the exit
    assert not out.exists()
    broken = lambda *a, **k: (_ for _ in ()).throw(BacktestError("no"))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(cli.backtest, "run_backtest", broken)
        assert cli.main(args) == 1
    stages = [json.loads(x) for p in Path(out).glob("stages/*.json") for x in p.read_text().splitlines()]
    assert stages == [{"ticker": "SYN", "stages": {"decomposition": "ok", "vrp": "ok", "backtest": "failed"}}]


def test_command_line_store(spark, files, capsys):
    """Files fill the store, which then serves without them."""
    prices, events, root = str(files / "prices.csv"), str(files / "events.csv"), str(files / "store")
    span = ["--start", "2023-01-01", "--end", "2024-12-31", "--cache-dir", root]
    assert cli.main(["-t", "SYN", "--prices-csv", prices, "--earnings-csv", events, *span]) == 0
    first = capsys.readouterr().out
    assert cli.main(["-t", "SYN", *span]) == 0
    assert capsys.readouterr().out == first


@pytest.mark.parametrize(("value", "text"), [(None, "n/a"), (float("nan"), "n/a"), (float("inf"), "inf"), (float("-inf"), "-inf"), (0.5, "50.00%")])
def test_numbers(value, text):
    assert cli.number(value, percent=True) == text
