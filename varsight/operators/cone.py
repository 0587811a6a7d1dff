"""Volatility cones: quantiles of rolling volatility by window."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ESTIMATORS, PERIODS_PER_YEAR
from ..functions.windows import positioned
from .estimators import rolling_variance

WINDOWS = (5, 10, 20, 30, 60, 90, 120)
QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


def checked_windows(windows, quantiles, estimator: str) -> list[int]:
    """The windows in order; raises where a setting is none."""
    if any(not 0 <= q <= 1 for q in quantiles):
        raise ValueError("quantiles must lie in [0, 1]")
    if estimator not in ESTIMATORS:
        raise ValueError(f"estimator must be one of {ESTIMATORS}")
    windows = sorted({int(w) for w in windows})
    if not windows or windows[0] < 2:
        raise ValueError("windows must hold numbers >= 2")
    return windows


def stacked_windows(positioned_bars: DataFrame, windows: list[int], estimator: str, annualized: bool, keep: list[str] | None = None) -> DataFrame:
    """``(ticker, pp, window, sigma)`` for windows that the history allows, from framed columns of one sorted pass."""
    df = reduce(lambda d, w: rolling_variance(d, estimator, w, f"v{w}"), windows, positioned_bars)
    pairs = F.array(*[F.struct(F.lit(w).alias("window"), F.col(f"v{w}").alias("v")) for w in windows])
    stacked = df.select("ticker", "pp", "n_sessions", *(keep or []), F.inline(pairs)).where((F.col("window") + 2 <= F.col("n_sessions")) & F.col("v").isNotNull())
    return stacked.withColumn("sigma", F.sqrt("v") * (PERIODS_PER_YEAR**0.5 if annualized else 1.0))


def vol_cone(bars: DataFrame, windows=WINDOWS, quantiles=QUANTILES, estimator: str = "close_to_close", annualized: bool = True) -> DataFrame:
    """``(ticker, window, qNN..., last, n_obs)`` for windows that the history allows."""
    windows = checked_windows(windows, quantiles, estimator)
    stacked = stacked_windows(positioned(bars), windows, estimator, annualized)
    named = [F.percentile("sigma", F.lit(float(q))).alias(f"q{round(q * 100):02d}") for q in quantiles]
    return stacked.groupBy("ticker", "window").agg(*named, F.max_by("sigma", "pp").alias("last"), F.count("sigma").alias("n_obs"))
