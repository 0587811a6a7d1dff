"""Summaries across tickers and the data behind charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import BacktestConfig, DecompositionConfig
from .backtest import run_backtest
from .decomposition import decompose_events, summarize
from .quantiles import settled


def cross_section(summary: DataFrame, stats: DataFrame) -> DataFrame:
    """One line per ticker, highest variance ratio first."""
    joined = summary.join(stats.select("ticker", "win_rate", "sharpe_ratio"), "ticker", "left")
    return joined.select(
        "ticker",
        F.col("n_events").alias("events"),
        F.col("mean_sigma_baseline").alias("baseline"),
        F.col("mean_sigma_jump").alias("jump"),
        F.col("mean_sigma_total").alias("total"),
        F.col("mean_variance_ratio").alias("var_ratio"),
        F.col("mean_abs_event_return").alias("mean_move"),
        F.col("downside_share"),
        F.col("clamp_rate"),
        "win_rate",
        F.col("sharpe_ratio").alias("sharpe"),
    ).orderBy(F.desc_nulls_last("var_ratio"), "ticker")


def universe_cross_section(bars: DataFrame, announcements: DataFrame, config: DecompositionConfig | None = None, backtest: BacktestConfig | None = None) -> DataFrame:
    """``cross_section`` of a whole universe, from its bars.

    Events are computed once and kept, a row for each: the summary and the trades
    both start from them, and the bars are framed once for each of the two.
    """
    events = settled(decompose_events(bars, announcements, config))
    return cross_section(summarize(events), run_backtest(bars, events, backtest, config, strict=False).stats)


def jump_histogram(events: DataFrame, bins: int = 20) -> DataFrame:
    """``(ticker, bin, bin_lo, bin_hi, n)`` of the jump volatility; the last bin is closed.

    A ticker whose values are all equal has one bin around them.
    """
    if bins < 1:
        raise ValueError("bins must be >= 1")
    span = events.groupBy("ticker").agg(F.min("sigma_jump").alias("_a"), F.max("sigma_jump").alias("_b"))
    flat = F.col("_a") == F.col("_b")
    span = span.select("ticker", F.when(flat, F.col("_a") - 0.5).otherwise(F.col("_a")).alias("lo"), F.when(flat, F.col("_b") + 0.5).otherwise(F.col("_b")).alias("hi"))
    rows = events.select("ticker", "sigma_jump").where("sigma_jump is not null").join(span, "ticker")
    width = (F.col("hi") - F.col("lo")) / bins
    rows = rows.withColumn("bin", F.least(F.lit(bins), F.floor((F.col("sigma_jump") - F.col("lo")) / width).cast("int") + 1))
    out = rows.groupBy("ticker", "bin", "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    return out.select("ticker", "bin", (F.col("lo") + width * (F.col("bin") - 1)).alias("bin_lo"), (F.col("lo") + width * F.col("bin")).alias("bin_hi"), "n")


def jump_summary(events: DataFrame) -> DataFrame:
    """What a jump chart marks: mean, median, zero jumps and mean baseline."""
    return events.groupBy("ticker").agg(
        F.avg("sigma_jump").alias("mean_jump"), F.median("sigma_jump").alias("median_jump"), F.count(F.when(F.col("sigma_jump") == 0, 1)).alias("n_zero"), F.avg("sigma_baseline").alias("mean_baseline")
    )


def decomposition_timeline(events: DataFrame) -> DataFrame:
    return events.select("ticker", "session_date", "sigma_baseline", "sigma_jump", "sigma_total", "variance_ratio", "jump_clamped")


def pnl_chart(equity: DataFrame) -> DataFrame:
    """Equity with its running peak and ratio drawdown, as a chart shows it: without the leading 1."""
    so_far = Window.partitionBy("ticker").orderBy("session_date").rowsBetween(Window.unboundedPreceding, 0)
    out = equity.select("ticker", "session_date", "return", "equity").withColumn("running_peak", F.max("equity").over(so_far))
    return out.withColumn("drawdown_ratio", F.when(F.col("running_peak") != 0, F.col("equity") / F.col("running_peak") - 1))


def premium_scatter(per_event: DataFrame) -> DataFrame:
    """Implied against realized moves, with the axis limit of a square chart."""
    top = F.max(F.greatest("implied_move", "realized_move")).over(Window.partitionBy("ticker"))
    return per_event.select("ticker", "session_date", "implied_move", "realized_move", (top * 1.1).alias("axis_limit"))


def event_table(events: DataFrame, rows: int = 12, places: int = 4) -> DataFrame:
    """The first events of every ticker with rounded figures, as a report lists them."""
    order = Window.partitionBy("ticker").orderBy("session_date")
    shown = ["sigma_baseline", "sigma_jump", "sigma_total", "variance_ratio", "event_return"]
    top = events.withColumn("place", F.row_number().over(order)).where(F.col("place") <= rows)
    return top.select("ticker", "place", "session_date", *[F.round(c, places).alias(c) for c in shown], "jump_clamped")


def stage_status(tickers: DataFrame, summary: DataFrame, premium_stats: DataFrame | None, trade_stats: DataFrame | None) -> DataFrame:
    """``(ticker, stages)``: for every ticker whether each stage is ok, failed or skipped.

    The premium is optional and skipped where it has no figures; a backtest
    that was not asked for is skipped.
    """
    out = tickers.select("ticker").distinct()

    def state(rows: DataFrame | None, name: str, lost: str) -> None:
        nonlocal out
        if rows is None:
            out = out.withColumn(name, F.lit("skipped"))
        else:
            out = out.join(rows.select("ticker", F.lit("ok").alias(name)), "ticker", "left").fillna(lost, [name])

    state(summary, "decomposition", "failed")
    state(premium_stats, "vrp", "skipped")
    state(trade_stats, "backtest", "failed")
    names = ("decomposition", "vrp", "backtest")
    return out.select("ticker", F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))]).alias("stages"))


def outcomes(tickers: DataFrame, summary: DataFrame, premium_stats: DataFrame | None, trade_stats: DataFrame | None) -> DataFrame:
    """``(ticker, stages, summary, premium, stats)``: what ``stage_status`` tells and the figures themselves, a row per ticker.

    The figures are null where a stage has none, so that one job over this frame
    gives a whole run's report.  Further columns of ``tickers`` stay.
    """
    out = tickers.dropDuplicates(["ticker"])
    status = []
    for stage, name, rows, lost in (("decomposition", "summary", summary, "failed"), ("vrp", "premium", premium_stats, "skipped"), ("backtest", "stats", trade_stats, "failed")):
        if rows is None:
            out, state = out.withColumn(name, F.lit(None).cast("struct<ticker: string>")), F.lit("skipped")
        else:
            out, state = out.join(rows.select("ticker", F.struct(*rows.columns).alias(name)), "ticker", "left"), F.when(F.col(name).isNotNull(), "ok").otherwise(lost)
        status += [F.lit(stage), state]
    return out.select(*tickers.columns, F.create_map(*status).alias("stages"), "summary", "premium", "stats")
