"""Histories in blocks, sliding moments, the equity scan and quantiles by counting, against plain forms and numpy."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import ohlcv
from varsight.config import DecompositionConfig
from varsight.functions.windows import positioned, sliding_moments
from varsight.operators import alignment, backtest, cone, decomposition, estimators, long_history, quantiles
from varsight.operators.long_history import BlockConfig

SMALL = BlockConfig(rows=50, grain=3)


@pytest.fixture(scope="module")
def bars(spark):
    """A long ticker, one of a few sessions, one of a single session."""
    rng = np.random.default_rng(8)
    frames = [ohlcv(rng.normal(0, 0.01, n), t, seed=k) for k, (t, n) in enumerate([("LONG", 700), ("MID", 120), ("TINY", 3)])]
    frames.append(frames[0].head(1).assign(ticker="ONE"))
    return spark.createDataFrame(pd.concat(frames)).repartition(3).cache()


@pytest.fixture(scope="module")
def announcements(spark):
    days = [dt.date(2019, 1, 1) + dt.timedelta(days=k) for k in (*range(0, 1100, 13), 5, 6, 7, 4000)]
    rows = [(t, d) for t in ("LONG", "MID", "TINY", "ONE", "NONE") for d in days]
    return spark.createDataFrame(rows, "ticker string, announcement_date date")


def same(a, b, digits=9):
    """Equal rows, numbers to so many places."""
    assert a.columns == b.columns
    keys = [c for c, t in a.dtypes if t != "double"]
    x, y = (df.toPandas().sort_values(keys, ignore_index=True) for df in (a, b))
    pd.testing.assert_frame_equal(x, y, check_dtype=False, rtol=0, atol=10.0**-digits)
    return len(x)


@pytest.mark.parametrize("cfg", [SMALL, BlockConfig(rows=2, grain=1), BlockConfig()])
def test_positions_and_returns(spark, bars, cfg):
    assert same(long_history.log_returns(bars, cfg), estimators.log_returns(bars)) == 700 + 120 + 3


@pytest.mark.parametrize("estimator", ["close_to_close", "parkinson", "yang_zhang"])
@pytest.mark.parametrize("window", [2, 20, 200])
def test_rolling_in_blocks(bars, estimator, window):
    """Windows below, at and above the rows of a block and the length from which moments are merged."""
    mine = long_history.rolling_volatility(bars, estimator, window, cfg=SMALL).select("ticker", "date", "sigma")
    assert same(mine, estimators.REGISTRY[estimator][1](bars, window)) == 701 + 121 + 4 + 1


@pytest.mark.parametrize(
    "cfg",
    [
        DecompositionConfig(),
        DecompositionConfig(baseline_windows=(10, 5), event_window=4, post_windows=(3,), announcement_offset=2, baseline_gap=3, zero_mean=False, ddof=1),
        DecompositionConfig(baseline_windows=(140,), estimator="yang_zhang"),
    ],
)
def test_events_in_blocks(bars, announcements, cfg):
    assert same(long_history.align_events(bars, announcements, cfg, SMALL), alignment.align_events(bars, announcements, cfg)) == 267
    assert same(long_history.decompose_events(bars, announcements, cfg, SMALL), decomposition.decompose_events(bars, announcements, cfg)) > 10


def test_cone_in_blocks(bars):
    select = quantiles.SelectConfig(grid=20, accuracy=50, few=10, salts=3)
    assert same(long_history.vol_cone(bars, (5, 20, 130), blocks=SMALL, select=select), cone.vol_cone(bars, (5, 20, 130))) == 5


def test_no_bars(spark, bars, announcements):
    none = bars.where("false")
    assert long_history.log_returns(none).count() == 0
    assert long_history.decompose_events(none, announcements).count() == 0
    with pytest.raises(ValueError):
        BlockConfig(rows=1)


def test_one_ticker_is_many_tasks(spark):
    """Stamped bars at uneven times: blocks are even, whatever the density of time."""
    n = 40_000
    k = F.col("id")
    ts = F.timestamp_seconds(k * 60 + F.when(k > 30_000, k * 5000).otherwise(0))
    ticks = spark.range(n).select(F.lit("A").alias("ticker"), ts.alias("date"), (100 + F.sin(k * 0.1) + F.cos(k * 1.7)).alias("close"))
    cfg = BlockConfig(rows=2000)
    rows = long_history.in_blocks(long_history.carried_positions(ticks, cfg=cfg), 100, 10, cfg)
    sizes = [r["count"] for r in rows.groupBy("ticker").count().collect()]
    assert len(sizes) == 20 and max(sizes) <= 2110 and rows.where("home").count() == n
    mine = long_history.rolling_volatility(ticks, "close_to_close", 150, cfg=cfg)
    assert mine._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(ticker#") >= 1
    whole = estimators.rolling_close_to_close(ticks, 150)
    gap = mine.join(whole.withColumnRenamed("sigma", "other"), ["ticker", "date"]).agg(F.max(F.abs(F.col("sigma") - F.col("other"))), F.count("sigma"), F.count("other")).first()
    assert gap[0] < 1e-9 and gap[1] == gap[2] == n - 150


def test_moments_do_not_cancel(spark):
    """Large values with small differences, and nulls among them."""
    rng = np.random.default_rng(1)
    x = 1e9 + rng.normal(0, 1e-2, 500)
    x[[0, 77, 200]] = np.nan
    rows = [("A", i, None if np.isnan(v) else float(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "ticker string, pp long, x double")
    for size in (1, 7, 64, 499, 600):
        out = sliding_moments(df, {"x": F.col("x")}, size).orderBy("pp").select("_m_x.*", "pp").collect()
        for row in out:
            part = x[max(0, row["pp"] - size + 1) : row["pp"] + 1]
            part = part[~np.isnan(part)]
            assert row["n"] == len(part)
            if len(part):
                centred = part - 1e9
                assert row["mean"] - 1e9 == pytest.approx(centred.mean(), abs=1e-6)
                assert row["m2"] == pytest.approx(((centred - centred.mean()) ** 2).sum(), rel=1e-3, abs=1e-9)


def test_long_windows_equal_short_forms(bars, monkeypatch):
    for estimator, (_, rolling) in estimators.REGISTRY.items():
        plain = rolling(bars, 40)
        with monkeypatch.context() as patch:
            patch.setattr(estimators, "LINEAR_FROM", 2)
            assert same(rolling(bars, 40), plain) > 800, estimator


@pytest.mark.parametrize("compound", [False, True])
@pytest.mark.parametrize("rows", [2, 7, 1000])
def test_equity_scan(spark, compound, rows):
    rng = np.random.default_rng(3)
    day = dt.date(2020, 1, 1)
    trades = [("A", day + dt.timedelta(days=int(k) * 3), float(v)) for k, v in enumerate(rng.normal(0, 0.3, 200).clip(-0.9, 2))]
    trades += [("B", day + dt.timedelta(days=k), None if k < 5 or k % 7 == 0 else 0.1) for k in range(40)]
    trades += [("C", day + dt.timedelta(days=k), -1.5 if k == 9 else 0.2) for k in range(30)] + [("D", day, -0.5), ("E", day, None)]
    df = spark.createDataFrame(trades, "ticker string, session_date date, return double")
    assert same(long_history.equity_curve(df, compound, BlockConfig(rows=rows, grain=2)), backtest.equity_curve(df, compound)) == 272


@pytest.mark.parametrize("cfg", [quantiles.SelectConfig(), quantiles.SelectConfig(grid=10, accuracy=20, few=5, salts=3)])
def test_quantiles_equal_percentile(spark, cfg):
    rng = np.random.default_rng(5)
    groups = {
        "normal": rng.normal(size=3000),
        "tails": np.concatenate([rng.standard_cauchy(800) * 1e6, 10.0 ** -rng.uniform(0, 300, 800), [-1e308, 1e308, 0.0, -0.0]]),
        "ties": rng.integers(0, 3, 2000).astype(float),
        "one value": np.full(1500, 7.25),
        "two": np.array([1.0, 2.0]),
        "single": np.array([3.5]),
        "infinite": np.array([-np.inf] * 30 + [np.inf] * 30 + [1.0] * 5),
    }
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("nulls", None), (None, 1.0), ("two", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    at = (0.0, 0.013, 0.25, 0.5, 0.77, 0.999, 1.0)
    mine = {r["g"]: (r["n"], r["quantiles"]) for r in quantiles.exact_quantiles(df, ["g"], "v", at, cfg).collect()}
    plain = {r["g"]: r["q"] for r in df.where("g is not null and v is not null").groupBy("g").agg(F.percentile("v", F.array(*[F.lit(q) for q in at])).alias("q")).collect()}
    assert set(mine) == set(groups)
    for g, values in groups.items():
        assert mine[g][0] == len(values)
        for a, b in zip(mine[g][1], plain[g], strict=True):
            assert a == b or abs(a - b) <= 1e-12 * abs(b) or (np.isnan(a) and np.isnan(b)), g


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert quantiles.exact_quantiles(df, ["g"], "v", (0.5,)).count() == 0
    with pytest.raises(ValueError):
        quantiles.exact_quantiles(df, ["g"], "v", (1.5,))
