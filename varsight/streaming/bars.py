"""Bars from a stream of ticks, or from a table of them by the same expression."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_bars(ticks: DataFrame, width: str = "1 hour", lateness: str | None = None) -> DataFrame:
    """``ticks(ticker, ts, price)`` to bars per window, ``(ticker, bar_start, open, high, low, close, n_ticks)``.

    With ``lateness`` the stream drops ticks that come later than that behind
    the newest, and a bar is emitted once no more can come.
    """
    if lateness is not None:
        ticks = ticks.withWatermark("ts", lateness)
    bars = ticks.groupBy("ticker", F.window("ts", width).alias("w")).agg(
        F.min_by("price", F.struct("ts", "price")).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", F.struct("ts", "price")).alias("close"),
        F.count(F.lit(1)).alias("n_ticks"),
    )
    return bars.select("ticker", F.col("w.start").alias("bar_start"), "open", "high", "low", "close", "n_ticks")


def event_ticks(events: DataFrame) -> DataFrame:
    """An event table as ticks: type is the ticker, value the price."""
    return events.select(F.col("event_type").alias("ticker"), "ts", F.col("value").alias("price"))
