"""Implied against realized event moves."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PERIODS_PER_YEAR
from ..functions.expressions import clean, implied_jump_move
from ..functions.windows import by_ticker


@dataclass(frozen=True)
class PremiumResult:
    """per_event: a row per event.  stats: a row per ticker.  source: of the implied moves."""

    per_event: DataFrame
    stats: DataFrame
    source: str

    def to_dict(self, ticker: str) -> dict[str, float | int | str | None]:
        """One ticker's figures and the source of its implied moves; empty if it has none."""
        row = self.stats.where(F.col("ticker") == ticker).first()
        return {} if row is None else row.asDict() | {"implied_source": self.source}


def volatility_risk_premium(
    events: DataFrame,
    implied_moves: float | DataFrame | None = None,
    implied_vols: float | DataFrame | None = None,
    days_to_expiry: int = 21,
    trim_quantile: float = 0.05,
    min_events: int = 4,
    annualized: bool = True,
    strict: bool = False,
) -> PremiumResult:
    """Premium of implied over realized moves.

    Implied moves are a number, or a table ``(ticker, session_date,
    implied_move)``, or follow from implied volatilities given likewise as
    ``implied_vol``; moves come before volatilities.  Without either they are
    the mean of a ticker's other events, whose premium is 0 on average by
    construction.  Tickers with fewer than ``min_events`` events are left out,
    or raise where ``strict``.
    """
    for c in ("abs_event_return", "sigma_baseline"):
        if c not in events.columns:
            raise ValueError(f"events have no column {c!r}")
    if not 0 <= trim_quantile < 0.5:
        raise ValueError("trim_quantile must be in [0, 0.5)")
    df = events.select("ticker", "session_date", clean(F.col("abs_event_return")).alias("realized_move"), F.col("sigma_baseline"))
    df = df.withColumn("_n", F.count(F.lit(1)).over(by_ticker())).where(F.col("_n") >= min_events)
    keys = ["ticker", "session_date"]
    if implied_moves is not None:
        if isinstance(implied_moves, DataFrame):
            source, df = "supplied_moves", df.join(implied_moves.select(*keys, clean(F.col("implied_move").cast("double")).alias("implied_move")), keys, "left")
        else:
            source, df = "constant_scenario", df.withColumn("implied_move", F.lit(float(implied_moves)))
    elif implied_vols is not None:
        if isinstance(implied_vols, DataFrame):
            source, df = "supplied_iv", df.join(implied_vols.select(*keys, clean(F.col("implied_vol").cast("double")).alias("_iv")), keys, "left")
        else:
            source, df = "constant_iv_scenario", df.withColumn("_iv", F.lit(float(implied_vols)))
        base = F.col("sigma_baseline") if annualized else F.col("sigma_baseline") * math.sqrt(PERIODS_PER_YEAR)
        df = df.withColumn("implied_move", implied_jump_move(F.col("_iv"), base, days_to_expiry))
    else:
        total = F.sum("realized_move").over(by_ticker())
        others = F.count("realized_move").over(by_ticker()) - 1
        source, df = "historical_proxy", df.withColumn("implied_move", F.when(others > 0, (total - F.col("realized_move")) / others))
    df = df.where("implied_move is not null and realized_move is not null")
    df = df.withColumn("_n", F.count(F.lit(1)).over(by_ticker())).where(F.col("_n") >= min_events)
    if strict and df.limit(1).count() == 0:
        raise ValueError(f"no ticker has {min_events} events with an implied and a realized move")
    df = df.withColumn("vrp", F.col("implied_move") - F.col("realized_move"))
    df = df.withColumn("vrp_ratio", F.when(F.col("realized_move") > 0, F.col("implied_move") / F.col("realized_move"))).withColumn("implied_source", F.lit(source))
    per_event = df.select(*keys, "implied_move", "realized_move", "vrp", "vrp_ratio", "implied_source")

    if trim_quantile > 0:
        marked = df.withColumn("_lo", F.percentile("vrp", trim_quantile).over(by_ticker())).withColumn("_hi", F.percentile("vrp", 1 - trim_quantile).over(by_ticker()))
        kept = (F.col("_n") < 5) | F.col("vrp").between(F.col("_lo"), F.col("_hi"))
    else:
        marked, kept = df, F.lit(True)
    n, sd = F.count("vrp"), F.stddev_samp("vrp")
    stats = marked.withColumn("_kept", kept).groupBy("ticker")
    stats = stats.agg(
        F.avg("vrp").alias("mean_vrp"),
        F.median("vrp").alias("median_vrp"),
        F.avg(F.when(F.col("_kept"), F.col("vrp"))).alias("mean_vrp_ex_outliers"),
        F.avg((F.col("implied_move") > F.col("realized_move")).cast("double")).alias("hit_rate"),
        F.when((n > 1) & (sd > 0), F.avg("vrp") / (sd / F.sqrt(n.cast("double")))).alias("t_stat"),
        n.alias("n_events"),
        F.count(F.when(~F.col("_kept"), 1)).alias("n_trimmed"),
    )
    return PremiumResult(per_event, stats, source)
