"""Realized-volatility estimators, over whole histories and rolling windows.

Input is bars ``(ticker, date, open, high, low, close, ...)``.  Point
estimators return a row per ticker, null where its history is too short; rolling
ones return a row per session.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PERIODS_PER_YEAR
from ..errors import InsufficientDataError
from ..functions.expressions import annualize
from ..functions.windows import by_session, full, positioned, sliding_moments, variance

LN2_4 = 4 * math.log(2)
#: Windows of so many sessions and more are merged from block prefixes and suffixes; shorter ones are plain frames.
LINEAR_FROM = 128


def _strict(df: DataFrame, column: str, least: int, strict: bool) -> DataFrame:
    if strict:
        short = df.where(F.col(column).isNull()).select("ticker", "n_obs").first()
        if short is not None:
            raise InsufficientDataError(f"history of {short['ticker']} is too short", required=least, available=short["n_obs"])
    return df


def log_returns(bars: DataFrame) -> DataFrame:
    """``(ticker, date, ret_pos, log_return)``, dated on the later session."""
    rows = positioned(bars).where("pp >= 1")
    return rows.select("ticker", "date", (F.col("pp") - 1).alias("ret_pos"), F.col("r").alias("log_return"))


def realized_variance(bars: DataFrame, zero_mean: bool = True, ddof: int = 0, strict: bool = False) -> DataFrame:
    """Per-session variance of log returns by ticker."""
    out = positioned(bars).groupBy("ticker").agg(variance(F.col("r"), zero_mean, ddof).alias("realized_variance"), F.count("r").alias("n_obs"))
    return _strict(out, "realized_variance", 1 if zero_mean else ddof + 1, strict)


def close_to_close(bars: DataFrame, annualized: bool = True, zero_mean: bool = False, ddof: int = 1, periods_per_year: float = PERIODS_PER_YEAR, strict: bool = False) -> DataFrame:
    out = realized_variance(bars, zero_mean, ddof).select("ticker", annualize(F.sqrt("realized_variance"), periods_per_year, annualized).alias("sigma"), "n_obs")
    return _strict(out, "sigma", ddof + 1, strict)


def _log_range() -> Column:
    x = F.ln(F.col("high") / F.col("low"))
    return x * x


def parkinson(bars: DataFrame, annualized: bool = True, periods_per_year: float = PERIODS_PER_YEAR) -> DataFrame:
    sigma = annualize(F.sqrt(F.avg(_log_range()) / LN2_4), periods_per_year, annualized)
    return bars.groupBy("ticker").agg(sigma.alias("sigma"), F.count(F.lit(1)).alias("n_obs"))


def with_overnight(df: DataFrame) -> DataFrame:
    """Adds the overnight and open-to-close returns and the Rogers-Satchell term."""
    up, down, close = F.ln(F.col("high") / F.col("open")), F.ln(F.col("low") / F.col("open")), F.ln(F.col("close") / F.col("open"))
    return (
        df.withColumn("_o", F.ln("open") - F.lag(F.ln("close")).over(by_session()))
        .withColumn("_c", F.when(F.col("_o").isNotNull(), close))
        .withColumn("_s", F.when(F.col("_o").isNotNull(), up * (up - close) + down * (down - close)))
    )


def _weight(n: Column | int) -> Column:
    n = n if isinstance(n, Column) else F.lit(float(n))
    return 0.34 / (1.34 + (n + 1) / (n - 1))


def yang_zhang(bars: DataFrame, annualized: bool = True, periods_per_year: float = PERIODS_PER_YEAR, strict: bool = False) -> DataFrame:
    """Needs three sessions; the first has no overnight return and is left out."""
    n = F.count("_o")
    k = _weight(n.cast("double"))
    v = F.var_samp("_o") + k * F.var_samp("_c") + (1 - k) * F.avg("_s")
    sigma = F.when(n >= 2, annualize(F.sqrt(F.greatest(v, F.lit(0.0))), periods_per_year, annualized))
    out = with_overnight(positioned(bars)).groupBy("ticker").agg(sigma.alias("sigma"), F.count(F.lit(1)).alias("n_obs"))
    return _strict(out, "sigma", 3, strict)


def rolling_variance(df: DataFrame, estimator: str, window: int, into: str, zero_mean: bool = False, ddof: int = 1) -> DataFrame:
    """``df`` from ``positioned`` with the per-session variance of the last ``window`` sessions."""
    if estimator not in ("close_to_close", "parkinson", "yang_zhang"):
        raise ValueError(f"unknown estimator {estimator!r}")
    if window >= LINEAR_FROM:
        return _linear_variance(df, estimator, window, into, zero_mean, ddof)
    frame = by_session().rowsBetween(-(window - 1), 0)
    if estimator == "close_to_close":
        return df.withColumn(into, full(variance(F.col("r"), zero_mean, ddof, frame), F.col("r"), frame, window))
    if estimator == "parkinson":
        x = _log_range()
        return df.withColumn(into, full(F.avg(x).over(frame) / LN2_4, x, frame, window))
    if "_o" not in df.columns:
        df = with_overnight(df)
    k = 0.34 / (1.34 + (window + 1) / (window - 1))
    v = F.var_samp("_o").over(frame) + k * F.var_samp("_c").over(frame) + (1 - k) * F.avg("_s").over(frame)
    return df.withColumn(into, full(F.greatest(v, F.lit(0.0)), F.col("_o"), frame, window))


def _linear_variance(df: DataFrame, estimator: str, window: int, into: str, zero_mean: bool, ddof: int) -> DataFrame:
    """The same from moments that are merged, so that a row costs as much whatever the window."""
    if estimator == "yang_zhang" and "_o" not in df.columns:
        df = with_overnight(df)
    r = F.col("r")
    of = {"close_to_close": {"r": r * r if zero_mean else r}, "parkinson": {"h": _log_range()}, "yang_zhang": {"o": F.col("_o"), "c": F.col("_c"), "s": F.col("_s")}}[estimator]
    columns = df.columns
    df = sliding_moments(df, of, window)
    if estimator == "close_to_close":
        m = F.col("_m_r")
        value = m["mean"] if zero_mean else F.when(F.lit(window > ddof), m["m2"] / (window - ddof if window > ddof else 1))
        whole = m["n"] == window
    elif estimator == "parkinson":
        value, whole = F.col("_m_h")["mean"] / LN2_4, F.col("_m_h")["n"] == window
    else:
        k = 0.34 / (1.34 + (window + 1) / (window - 1))
        o, c, s = (F.col(f"_m_{x}") for x in "ocs")
        value = F.greatest(o["m2"] / (window - 1) + k * c["m2"] / (window - 1) + (1 - k) * s["mean"], F.lit(0.0))
        whole = o["n"] == window
    return df.select(*[c for c in columns if c != into], F.when(whole, value).alias(into))


def _rolling(bars: DataFrame, estimator: str, window: int, least: int, annualized: bool, periods_per_year: float, **kind) -> DataFrame:
    if window < least:
        raise ValueError(f"window must be >= {least}")
    df = rolling_variance(positioned(bars), estimator, window, "_v", **kind)
    return df.select("ticker", "date", annualize(F.sqrt("_v"), periods_per_year, annualized).alias("sigma"))


def rolling_close_to_close(bars: DataFrame, window: int, annualized: bool = True, zero_mean: bool = False, ddof: int = 1, periods_per_year: float = PERIODS_PER_YEAR) -> DataFrame:
    return _rolling(bars, "close_to_close", window, 2, annualized, periods_per_year, zero_mean=zero_mean, ddof=ddof)


def rolling_parkinson(bars: DataFrame, window: int, annualized: bool = True, periods_per_year: float = PERIODS_PER_YEAR) -> DataFrame:
    return _rolling(bars, "parkinson", window, 1, annualized, periods_per_year)


def rolling_yang_zhang(bars: DataFrame, window: int, annualized: bool = True, periods_per_year: float = PERIODS_PER_YEAR) -> DataFrame:
    return _rolling(bars, "yang_zhang", window, 2, annualized, periods_per_year)


REGISTRY: dict[str, tuple[Callable[..., DataFrame], Callable[..., DataFrame]]] = {
    "close_to_close": (close_to_close, rolling_close_to_close),
    "parkinson": (parkinson, rolling_parkinson),
    "yang_zhang": (yang_zhang, rolling_yang_zhang),
}
