"""Bars in buckets, recorded answers as a data source, table functions and keyed streams."""

from __future__ import annotations

import datetime as dt
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import ohlcv
from varsight.errors import SourceError
from varsight.operators import alignment, decomposition, estimators, quality
from varsight.operators.table_functions import register_table_functions
from varsight.sources import buckets, recorded
from varsight.streaming import sessions


@pytest.fixture(scope="module")
def bars(spark):
    rng = np.random.default_rng(11)
    frames = [ohlcv(rng.normal(0, 0.01, 200 + 30 * k), t, seed=k) for k, t in enumerate(("AAA", "BBB", "CCC", "D/D"))]
    return spark.createDataFrame(pd.concat(frames)).cache()


@pytest.fixture(scope="module")
def announcements(spark):
    rows = [(t, dt.date(2019, 1, 1) + dt.timedelta(days=k)) for t in ("AAA", "BBB", "CCC", "D/D") for k in range(0, 300, 9)]
    return spark.createDataFrame(rows, "ticker string, announcement_date date")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def exchanges_over(text, scan):
    """Exchanges of a plan that stand above a scan: those of less indentation on the way to it."""
    lines = [(len(re.match(r"[ :+|-]*", x)[0]), x) for x in text.splitlines() if x.strip()]
    found = 0
    for k, (depth, line) in enumerate(lines):
        if scan in line:
            for d, x in reversed(lines[:k]):
                if d < depth:
                    depth = d
                    found += "Exchange" in x
    return found


def test_bars_in_buckets_are_not_shuffled(spark, bars, announcements):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(before, ("false", "-1"), strict=True):
            spark.conf.set(k, v)
        buckets.write_buckets(bars, "bucketed_bars", 3)
        stored, n = buckets.read_buckets(spark, "bucketed_bars")
        assert n == 3
        events = decomposition.decompose_events(stored, announcements, partitions=n)
        assert "bucketed_bars" in plan(events) and exchanges_over(plan(events), "bucketed_bars") == 0
        bars.write.mode("overwrite").saveAsTable("plain_bars")
        plain = decomposition.decompose_events(spark.table("plain_bars"), announcements)
        assert exchanges_over(plan(plain), "plain_bars") == 1  # bars by ticker, and then no more
        assert rows(events) == rows(plain) and events.count() > 30
        with pytest.raises(SourceError):
            buckets.read_buckets(spark, "plain_bars")
        with pytest.raises(ValueError):
            buckets.write_buckets(bars, "bucketed_bars", 0)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        for name in ("bucketed_bars", "plain_bars"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


@pytest.fixture(scope="module")
def answers(tmp_path_factory, bars):
    root = tmp_path_factory.mktemp("answers")
    for (ticker, year, month), part in _months(bars):
        folder = root / ticker.replace("/", "%2F")
        folder.mkdir(exist_ok=True)
        last = (dt.date(year + month // 12, month % 12 + 1, 1) - dt.timedelta(days=1)).isoformat()
        part.rename(columns=str.capitalize)[["Date", "Open", "High", "Low", "Close", "Volume"]].to_csv(folder / f"{year}-{month:02d}-01_{last}.csv", index=False)
    return str(root)


def _months(bars):
    frame = bars.toPandas()
    day = pd.to_datetime(frame["date"])
    for (ticker, year, month), part in frame.groupby([frame["ticker"], day.dt.year, day.dt.month]):
        yield (ticker, int(year), int(month)), part


def test_recorded_answers(spark, answers, bars):
    df = recorded.recorded_prices(spark, answers)
    assert rows(df) == rows(bars.select(*df.columns))
    n = sum(1 for _ in _months(bars))
    assert df.rdd.getNumPartitions() == n > 30


def test_filters_choose_the_answers(spark, answers, bars):
    """Filters on ticker and date leave the plan and choose the partitions; others stay in Spark."""
    df = recorded.recorded_prices(spark, answers)
    some = df.where("ticker = 'BBB' and date >= '2019-03-10' and date < '2019-05-02' and close > 0")
    assert some.rdd.getNumPartitions() == 3
    filters = [x for x in plan(some).splitlines() if "Filter (" in x]
    assert len(filters) == 1 and "close" in filters[0] and "date" not in filters[0].split("Filter")[1].split("BatchScan")[0]
    assert rows(some) == rows(bars.where("ticker = 'BBB' and date >= '2019-03-10' and date < '2019-05-02'").select(*df.columns))
    cases = ["ticker in ('AAA', 'D/D') and date = '2019-02-05'", "date > '2019-10-01'", "date <= '2019-01-03' and ticker <> 'AAA'", "ticker = 'NONE'", "ticker = 'AAA' and ticker = 'BBB'", "ticker like 'A%' and date between '2019-02-01' and '2019-02-28'"]
    for case in cases:
        assert rows(df.where(case)) == rows(bars.where(case).select(*df.columns)), case
    assert df.where("ticker = 'AAA'").select("close", "ticker").count() == 201


def test_table_functions(spark, bars, announcements):
    register_table_functions(spark, bars, announcements)
    assert rows(spark.sql("SELECT * FROM decomposed_events()")) == rows(decomposition.decompose_events(bars, announcements))
    assert rows(spark.sql("SELECT * FROM aligned_events('BBB')")) == rows(alignment.align_events(bars, announcements).where("ticker = 'BBB'"))
    part = spark.sql("SELECT * FROM decomposed_events(first => DATE'2019-06-01', last => DATE'2019-07-01')")
    assert rows(part) == rows(decomposition.decompose_events(bars, announcements).where("session_date between '2019-06-01' and '2019-07-01'"))


def stream(spark, tmp_path, parts, operator, name):
    folder = tmp_path / name
    folder.mkdir()
    query = operator(spark.readStream.schema(parts[0].schema).parquet(str(folder))).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}_state")).start()
    try:
        for part in parts:
            part.coalesce(1).write.mode("append").parquet(str(folder))
            query.processAllAvailable()
    finally:
        query.stop()
    return spark.table(name)


def test_a_stream_in_three_batches_equals_the_table(spark, tmp_path, bars):
    holed = bars.where("not (month(date) = 4 and day(date) > 9) and not (month(date) = 8 and day(date) between 3 and 14)").select("ticker", "date", "close")
    saturday = spark.createDataFrame([("AAA", dt.date(2019, 4, 20), 100.0), ("NEW", dt.date(2019, 8, 3), 5.0), ("NEW", dt.date(2019, 8, 30), 6.0)], holed.schema)
    table = holed.unionByName(saturday).cache()
    day = F.col("date")
    parts = [table.where(day < "2019-04-20"), table.where((day >= "2019-04-20") & (day < "2019-08-20")), table.where(day >= "2019-08-20")]
    found = stream(spark, tmp_path, parts, sessions.stream_returns, "returns")
    want = estimators.log_returns(table)
    assert [r[:3] for r in rows(found)] == [r[:3] for r in rows(want)]
    assert max(abs(a[3] - b[3]) for a, b in zip(rows(found), rows(want), strict=True)) < 1e-12
    gaps = stream(spark, tmp_path, parts, sessions.stream_gaps, "gaps")
    assert rows(gaps.select("ticker", "gap_start", "gap_end", "n_days")) == rows(quality.detect_gaps(table)) and gaps.count() >= 9


def test_late_and_repeated_bars_of_a_stream_are_dropped(spark, tmp_path):
    rows_of = lambda *r: spark.createDataFrame(list(r), "ticker string, date date, close double")
    d = lambda k: dt.date(2024, 1, k)
    parts = [rows_of(("A", d(3), 3.0), ("A", d(2), 2.0), ("A", d(2), 2.5)), rows_of(("A", d(3), 9.0), ("A", d(1), 1.0)), rows_of(("A", d(8), 6.0), ("B", d(8), 1.0), ("A", None, 1.0))]
    found = rows(stream(spark, tmp_path, parts, sessions.stream_returns, "late"))
    assert [r[:3] for r in found] == [("A", d(3), 0), ("A", d(8), 1)]
    assert found[0][3] == pytest.approx(np.log(1.5)) and found[1][3] == pytest.approx(np.log(2))
