"""Counters that ride on a job: ``DataFrame.observe`` in place of passes of their own.

Each function returns the frame to go on with and an ``Observation`` whose
``get`` waits for the first action on that frame.  The counts are kept by the
tasks that go through the rows anyway, and merged on the way back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .alignment import ALIGNED, DUPLICATE, FUTURE, SHORT
from .quality import PRICES, row_rules

STAGES = ("decomposition", "vrp", "backtest")


def observe_bars(bars: DataFrame, allow_zero_volume: bool = True) -> tuple[DataFrame, Observation]:
    """Counts of ``quality.violations`` over all tickers, but for repeated dates, which take a shuffle.

    ``n_rows``, ``n_incomplete``, ``n_broken`` (rows that break any rule), one
    count for each rule, and the first and last date.
    """
    rules = {name: F.coalesce(rule, F.lit(False)) for name, rule in row_rules(allow_zero_volume).items()}
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in PRICES])
    seen = Observation()
    counts = [F.count(F.lit(1)).alias("n_rows"), F.count(F.when(~whole, 1)).alias("n_incomplete")]
    counts += [F.count(F.when(reduce(lambda a, b: a | b, rules.values()), 1)).alias("n_broken")]
    counts += [F.count(F.when(rule, 1)).alias(f"n_{name}") for name, rule in rules.items()]
    counts += [F.min("date").alias("first_date"), F.max("date").alias("last_date")]
    return bars.observe(seen, *counts), seen


def observe_alignment(status: DataFrame) -> tuple[DataFrame, Observation]:
    """How many announcements ended in each status."""
    seen = Observation()
    return status.observe(seen, *[F.count(F.when(F.col("status") == k, 1)).alias(f"n_{k}") for k in (ALIGNED, FUTURE, SHORT, DUPLICATE)]), seen


def observe_events(events: DataFrame) -> tuple[DataFrame, Observation]:
    """``n_events`` and ``n_clamped`` of an event frame."""
    seen = Observation()
    return events.observe(seen, F.count(F.lit(1)).alias("n_events"), F.count(F.when(F.col("jump_clamped"), 1)).alias("n_clamped")), seen


def observe_stages(outcomes: DataFrame) -> tuple[DataFrame, Observation]:
    """``n_tickers``, ``n_failed`` (rows with a ``failure``, where there is that column) and counts such as ``n_vrp_skipped``."""
    seen = Observation()
    counts = [F.count(F.lit(1)).alias("n_tickers")]
    if "failure" in outcomes.columns:
        counts.append(F.count("failure").alias("n_failed"))
    counts += [F.count(F.when(F.col("stages")[s] == k, 1)).alias(f"n_{s}_{k}") for s in STAGES for k in ("ok", "failed", "skipped")]
    return outcomes.observe(seen, *counts), seen
