"""Returns and gaps from a stream of finished bars, with a state for each ticker.

An addition: the operators over tables have no counterpart in time.  A ticker's
state is its last session, so a bar that arrives in a later micro-batch meets
what came before it, and a stream gives what the table of its bars does.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from ..operators.quality import MAX_HOLIDAY_RUN

_DAY = dt.timedelta(days=1)


def _in_order(batches: Iterator[pd.DataFrame], after: dt.date | None) -> list[tuple[dt.date, float]]:
    """New sessions of a micro-batch by date: those after the last one, the first of a date."""
    rows = sorted((r.date, r.close) for b in batches for r in b.itertuples() if r.date is not None)
    found: list[tuple[dt.date, float]] = []
    for day, close in rows:
        if (after is None or day > after) and (not found or day > found[-1][0]):
            found.append((day, close))
    return found


def stream_returns(bars: DataFrame) -> DataFrame:
    """``(ticker, date, ret_pos, log_return)`` of a stream ``(ticker, date, close)``, as ``estimators.log_returns``.

    Bars may come in any order within a micro-batch.  One that is dated on or
    before a session of an earlier one is late and dropped, as positions are
    given out already.
    """

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, position, close = state.get if state.exists else (None, -1, None)
        out = []
        for day, price in _in_order(batches, None if last is None else dt.date.fromordinal(last)):
            position += 1
            if close is not None:
                out.append((key[0], day, position - 1, math.log(price) - math.log(close)))
            last, close = day.toordinal(), price
        if last is not None:
            state.update((last, position, close))
        yield pd.DataFrame(out, columns=["ticker", "date", "ret_pos", "log_return"])

    rows = bars.select("ticker", "date", F.col("close").cast("double").alias("close")).where("close > 0").groupBy("ticker")
    return rows.applyInPandasWithState(advance, "ticker string, date date, ret_pos long, log_return double", "last long, position long, close double", "append", "NoTimeout")


def stream_gaps(bars: DataFrame, max_holiday_run: int = MAX_HOLIDAY_RUN) -> DataFrame:
    """``(ticker, gap_start, gap_end, n_days)`` of a stream ``(ticker, date)``, as ``quality.detect_gaps``.

    A run of missing weekdays ends, and is returned, with the next session on a
    weekday; one on a weekend does not end it.
    """

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, begin, end, n = state.get if state.exists else (None, None, None, 0)
        out = []
        for day, _ in _in_order(batches, None if last is None else dt.date.fromordinal(last)):
            missing = dt.date.fromordinal(last) + _DAY if last is not None else day
            while missing < day:
                if missing.weekday() < 5:
                    begin, end, n = (missing.toordinal() if n == 0 else begin), missing.toordinal(), n + 1
                missing += _DAY
            if day.weekday() < 5:
                if n > max_holiday_run:
                    out.append((key[0], dt.date.fromordinal(begin), dt.date.fromordinal(end), n))
                begin, end, n = None, None, 0
            last = day.toordinal()
        if last is not None:
            state.update((last, begin, end, n))
        yield pd.DataFrame(out, columns=["ticker", "gap_start", "gap_end", "n_days"])

    rows = bars.select("ticker", "date", F.lit(0.0).alias("close")).groupBy("ticker")
    return rows.applyInPandasWithState(advance, "ticker string, gap_start date, gap_end date, n_days long", "last long, begin long, end long, n long", "append", "NoTimeout")
