"""One local session for all tests, and the synthetic price histories they use."""

from __future__ import annotations

import datetime as dt
import os
import sys
from pathlib import Path

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

import numpy as np  # noqa: E402
import pandas as pd  # noqa: E402
import pytest  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    scratch = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"file://{scratch}/checkpoints")
        .config("spark.sql.warehouse.dir", f"{scratch}/warehouse")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def weekdays(n: int, start: str = "2019-01-02") -> list[dt.date]:
    return [d.date() for d in pd.bdate_range(start, periods=n)]


def ohlcv(returns: np.ndarray, ticker: str = "AAA", start: str = "2019-01-02", first: float = 100.0, spread: float = 0.006, seed: int = 0) -> pd.DataFrame:
    """Bars whose closes follow the returns; the first close comes before them."""
    rng = np.random.default_rng(seed)
    close = first * np.exp(np.concatenate([[0.0], np.cumsum(returns)]))
    high = close * (1 + np.abs(rng.normal(0, spread, len(close))))
    low = close * (1 - np.abs(rng.normal(0, spread, len(close))))
    before = np.concatenate([[close[0]], close[:-1]])
    opened = np.clip(before * (1 + rng.normal(0, spread / 2, len(close))), low, high)
    return pd.DataFrame({"ticker": ticker, "date": weekdays(len(close), start), "open": opened, "high": high, "low": low, "close": close, "volume": 1e6})


def sample_history() -> tuple[pd.DataFrame, list[dt.date]]:
    """A documented synthetic history of 521 sessions with seven events."""
    j = np.arange(520)
    r = 0.006 * np.sin(1.7 * j) + 0.004 * np.cos(0.37 * j)
    for at, move in zip((85, 148, 211, 274, 337, 400, 463), (0.04, -0.06, 0.025, -0.08, 0.045, 0.03, -0.055), strict=True):
        r[at] = move
    close = 100 * np.exp(np.concatenate([[0.0], np.cumsum(r)]))
    opened = np.concatenate([[close[0]], close[:-1]])
    high, low = np.maximum(opened, close) * 1.004, np.minimum(opened, close) * 0.996
    bars = pd.DataFrame({"ticker": "SYN", "date": weekdays(521, "2023-01-02"), "open": opened, "high": high, "low": low, "close": close, "volume": 1e6})
    dates = ["2023-05-02", "2023-07-28", "2023-10-25", "2024-01-22", "2024-04-18", "2024-07-16", "2024-10-11"]
    return bars, [dt.date.fromisoformat(d) for d in dates]


@pytest.fixture(scope="session")
def sample(spark):
    bars, dates = sample_history()
    events = spark.createDataFrame([("SYN", d) for d in dates], "ticker string, announcement_date date")
    return spark.createDataFrame(bars), events
