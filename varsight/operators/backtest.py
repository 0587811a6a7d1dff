"""Delta-hedged event option trades, revalued session by session.

Entry inputs look back only: the baseline ends at the entry session and the
event move is the mean of events that were complete by then.  Each trade's
path is exploded to a row per session, both legs are revalued there, and the
steps are summed back; every key starts with the ticker.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..config import BacktestConfig, DecompositionConfig
from ..errors import BacktestError, InsufficientDataError, SchemaError
from ..functions.expressions import SQRT_2_OVER_PI, finite, with_straddles
from ..functions.windows import by_session, by_ticker, full, positioned, variance
from .estimators import rolling_variance

_KEY = ["ticker", "session_date"]

TRADE_COLUMNS = (
    "announcement_date entry_date event_date exit_date entry_spot exit_spot strike sigma_baseline front_iv implied_event_move "
    "entry_baseline_date history_events back_iv front_premium back_premium net_credit front_entry_execution back_entry_execution "
    "model_gross_pnl execution_adjustment realized_move front_pnl back_pnl cost net_pnl capital_basis return"
).split()


def _by_event() -> WindowSpec:
    return Window.partitionBy("ticker").orderBy("session_date")


@dataclass(frozen=True)
class BacktestResult:
    """trades: a row per trade.  skipped: how many events of each ticker were
    not traded.  bars, events: what was traded on.
    """

    trades: DataFrame
    skipped: DataFrame
    bars: DataFrame
    events: DataFrame
    config: BacktestConfig
    iv_source: str

    @cached_property
    def equity(self) -> DataFrame:
        """The running curve of the trades."""
        return equity_curve(self.trades, self.config.compound)

    @cached_property
    def stats(self) -> DataFrame:
        """A row per ticker; see ``trade_stats``."""
        return trade_stats(self.trades, self.config)

    @cached_property
    def problems(self) -> DataFrame:
        """What is wrong with a ticker's bars, positions or returns, where nothing was raised; see ``input_problems`` and ``return_problems``."""
        return input_problems(self.bars, self.events, self.config).unionByName(return_problems(self.trades, self.config))

    def summary_table(self) -> DataFrame:
        """The figures for people; see ``summary_table``."""
        return summary_table(self.stats)


def input_problems(bars: DataFrame, events: DataFrame, cfg: BacktestConfig) -> DataFrame:
    """``(ticker, problem)``: what ``validate_inputs`` would raise for, for every ticker that has it.

    One aggregation of the bars and one of the events, each by ticker.
    """
    usable = F.coalesce(finite(F.col("close")) & (F.col("close") > 0), F.lit(False))
    b = bars.groupBy("ticker").agg((F.count(F.lit(1)) - F.countDistinct("date")).alias("repeats"), F.count(F.when(~usable, 1)).alias("bad"), F.count(F.lit(1)).alias("n"))
    p = F.col("return_position").cast("double")
    e = events.groupBy("ticker").agg(
        F.count(F.when(~F.coalesce(finite(p) & (p == F.floor(p)) & (p >= 0), F.lit(False)), 1)).alias("odd"), F.max(p).alias("last"), (F.count(F.lit(1)) - F.countDistinct("return_position")).alias("again")
    )
    least = cfg.holding_sessions + 2
    cases = [
        F.when(F.col("repeats") > 0, F.lit("prices need unique session dates")),
        F.when(F.col("bad") > 0, F.format_string("%d closes are not finite and positive", "bad")),
        F.when(F.col("n") < least, F.format_string(f"%d sessions; one holding period needs {least}", "n")),
        F.when((F.col("odd") > 0) | (F.col("again") > 0) | (F.col("last") + 1 >= F.col("n")), F.lit("event positions must be finite, unique and inside the history")),
    ]
    return b.join(e, "ticker", "left").select("ticker", F.explode(F.filter(F.array(*cases), lambda x: x.isNotNull())).alias("problem"))


def return_problems(trades: DataFrame, cfg: BacktestConfig) -> DataFrame:
    """``(ticker, problem)``: trades without a positive capital basis, and returns that cannot be compounded where they are to be."""
    found = trades.groupBy("ticker").agg(F.count(F.when(~F.coalesce(F.col("capital_basis") > 0, F.lit(False)), 1)).alias("basis"), F.count(F.when(F.col("return") <= -1, 1)).alias("ruin"))
    cases = [F.when(F.col("basis") > 0, F.format_string("%d trades have no positive capital basis", "basis"))]
    if cfg.compound:
        cases.append(F.when(F.col("ruin") > 0, F.format_string("%d returns at or below -100%% cannot be compounded", "ruin")))
    return found.select("ticker", F.explode(F.filter(F.array(*cases), lambda x: x.isNotNull())).alias("problem"))


def validate_inputs(bars: DataFrame, events: DataFrame, cfg: BacktestConfig) -> None:
    """Raise on repeated dates, bad closes or bad event positions, in two aggregations."""
    for c in ("return_position", "sigma_baseline", "abs_event_return"):
        if c not in events.columns:
            raise SchemaError(f"events have no column {c!r}")
    b = bars.groupBy("ticker").agg(
        (F.count(F.lit(1)) - F.countDistinct("date")).alias("repeats"),
        F.count(F.when(~F.coalesce(finite(F.col("close")) & (F.col("close") > 0), F.lit(False)), 1)).alias("bad"),
        F.count(F.lit(1)).alias("n"),
    )
    worst = b.agg(F.max("repeats"), F.max("bad"), F.min("n")).first()
    if worst[0]:
        raise SchemaError("prices need unique session dates")
    if worst[1]:
        raise SchemaError("closes must be finite and positive")
    if worst[2] is not None and worst[2] < cfg.holding_sessions + 2:
        raise InsufficientDataError("history is shorter than one holding period", required=cfg.holding_sessions + 2, available=worst[2])
    e = events.join(b.select("ticker", "n"), "ticker", "left")
    p = F.col("return_position").cast("double")
    bad = ~F.coalesce(finite(p) & (p == F.floor(p)) & (p >= 0) & (p + 1 < F.col("n")), F.lit(False))
    found = e.agg(
        F.count(F.lit(1)), F.count(F.when(bad, 1)), F.countDistinct("ticker", "return_position"), F.countDistinct("ticker", "session_date")
    ).first()
    if not found[0]:
        raise BacktestError("there are no events")
    if found[1] or found[2] != found[0] or found[3] != found[0]:
        raise SchemaError("event positions must be finite, unique and inside the history")


def entry_inputs(bars: DataFrame, events: DataFrame, cfg: BacktestConfig, events_config: DecompositionConfig | None = None) -> DataFrame:
    """Every event with what was known at its entry and its price path.

    An event whose path lacks a close is not priceable.  ``calibration`` is null until ``min_history_events`` earlier events were
    complete by the entry.  ``usable`` says that path, baseline and, unless
    volatilities are supplied, calibration exist.
    """
    ev = events_config or DecompositionConfig()
    df = positioned(bars)
    w = ev.primary_baseline
    if ev.estimator == "close_to_close":
        frame = by_session().rowsBetween(-(w - 1), 0)
        df = df.withColumn("_v", full(variance(F.col("r"), ev.zero_mean, ev.ddof, frame), F.col("r"), frame, w))
    else:
        df = rolling_variance(df, ev.estimator, w, "_v")
    entry, leave = cfg.entry_offset, cfg.exit_offset
    # by single offsets, so that a missing close stays in its place
    path = F.array(*[F.lag("close", -k).over(by_session()) for k in range(-entry, leave + 1)])
    at = {
        "baseline": F.sqrt(F.lag("_v", entry).over(by_session()) * cfg.periods_per_year),
        "entry_date": F.lag("date", entry).over(by_session()),
        "exit_date": F.lead("date", leave).over(by_session()),
        "entry_spot": F.lag("close", entry).over(by_session()),
        "exit_spot": F.lead("close", leave).over(by_session()),
        "path": path,
    }
    sessions = df.withColumns(at).select("ticker", "pp", F.col("date").alias("event_date"), "n_sessions", *at)
    keyed = events.select("ticker", "session_date", "announcement_date", (F.col("return_position") + 1).cast("long").alias("pp"), "abs_event_return")
    rows = keyed.join(sessions, ["ticker", "pp"])
    # an earlier event is complete by the entry if it starts E + W - 1 sessions before the event
    prior = Window.partitionBy("ticker").orderBy("pp").rangeBetween(Window.unboundedPreceding, -(entry + ev.event_window - 1))
    move = F.when(finite(F.col("abs_event_return")), F.col("abs_event_return"))
    rows = rows.withColumn("history_events", F.count(move).over(prior)).withColumn("_mean", F.avg(move).over(prior))
    rows = rows.withColumn("calibration", F.when(F.col("history_events") >= cfg.min_history_events, F.col("_mean") * cfg.implied_move_multiplier))
    inside = (F.col("pp") >= cfg.back_need) & (F.col("pp") + cfg.forward_need < F.col("n_sessions"))
    whole = F.forall("path", lambda c: F.coalesce(finite(c) & (c > 0), F.lit(False)))
    priced = F.coalesce(finite(F.col("baseline")) & (F.col("baseline") > 0), F.lit(False)) & whole
    return rows.withColumn("priceable", inside & priced).withColumn("usable", F.col("priceable") & F.col("calibration").isNotNull()).drop("_mean")


def _revalued(path: DataFrame, legs: dict[str, tuple[int, Column, Column]], loaded_until: int, cfg: BacktestConfig) -> DataFrame:
    """Adds value, delta and volatility of straddles ``(expiry step, baseline, jump variance)``.

    The jump variance is still ahead through step ``loaded_until``; an expired
    straddle has its intrinsic value.
    """
    t = F.col("t")
    taus = {name: F.when(t < expiry, (F.lit(expiry) - t) * cfg.dt).otherwise(F.lit(1.0)) for name, (expiry, _, _) in legs.items()}

    def sigma(name: str) -> Column:
        _, base, jump = legs[name]
        loaded = F.when(t <= loaded_until, jump).otherwise(F.lit(0.0))
        return F.sqrt(F.greatest((base * base * taus[name] + loaded) / taus[name], F.lit(1e-12)))

    path = path.withColumns({f"{name}_sigma": sigma(name) for name in legs})
    path = with_straddles(path, {f"{name}_bs": (F.col("spot"), F.col("entry_spot"), F.col(f"{name}_sigma"), taus[name]) for name in legs}, cfg.rate)
    columns = {}
    for name, (expiry, _, _) in legs.items():
        columns[f"{name}_value"] = F.when(t < expiry, F.col(f"{name}_bs.price")).otherwise(F.abs(F.col("spot") - F.col("entry_spot")))
        columns[f"{name}_delta"] = F.col(f"{name}_bs.delta")
        columns[f"{name}_alive"] = t < expiry
    return path.withColumns(columns)


def _pnl(name: str) -> Column:
    step = Window.partitionBy(*_KEY).orderBy("t")
    gain = F.lead(f"{name}_value").over(step) - F.col(f"{name}_value") - F.col(f"{name}_delta") * (F.lead("spot").over(step) - F.col("spot"))
    return F.when(F.col(f"{name}_alive"), gain)


def run_backtest(
    bars: DataFrame,
    events: DataFrame,
    config: BacktestConfig | None = None,
    events_config: DecompositionConfig | None = None,
    implied_vols: float | DataFrame | None = None,
    implied_vol_days: int | None = None,
    strict: bool = True,
) -> BacktestResult:
    """Trade every usable event.

    By default bad inputs raise: repeated dates, closes that are not positive, short histories, positions outside them,
    no usable event, a capital basis that is not positive, returns of -100 % or less that are to be compounded.  A universe of which
    a few tickers are bad runs with ``strict=False``, where nothing raises and ``problems`` tells the same by ticker.

    ``implied_vols`` is a number, or a table ``(ticker, session_date,
    implied_vol, observed_at)`` whose observations must be no later than 16:00
    New York time of the entry session; an event with a missing, bad or later
    one is not traded, or raises where ``strict``.
    """
    cfg, ev = config or BacktestConfig(), events_config or DecompositionConfig()
    if implied_vol_days is not None and implied_vol_days <= 0:
        raise BacktestError("implied_vol_days must be strictly positive")
    scalar = implied_vols is not None and not isinstance(implied_vols, DataFrame)
    if scalar and not (math.isfinite(implied_vols) and implied_vols > 0):
        raise BacktestError("implied volatilities must be finite and strictly positive")
    if strict:
        validate_inputs(bars, events, cfg)
    last = cfg.last_loaded_step(ev.event_window)
    rows = entry_inputs(bars, events, cfg, ev)
    front_tau = (cfg.entry_offset + cfg.front_expiry_offset) * cfg.dt
    if implied_vols is None:
        source = f"expanding_historical_move_scenario(k={cfg.implied_move_multiplier:g})"
        rows = rows.withColumn("_use", F.col("usable")).withColumn("jump_var", F.pow(F.col("calibration") / SQRT_2_OVER_PI, F.lit(2.0)))
    else:
        if scalar:
            source = "constant_iv_scenario"
            rows = rows.withColumn("_iv", F.lit(float(implied_vols))).withColumn("_ok", F.lit(True))
        else:
            source = "timestamped_iv"
            if "observed_at" not in implied_vols.columns:
                raise BacktestError("implied volatilities by event need observed_at timestamps")
            given = implied_vols.select(*_KEY, F.col("implied_vol").cast("double").alias("_iv"), "observed_at")
            closing = F.to_utc_timestamp(F.to_timestamp(F.concat(F.date_format("entry_date", "yyyy-MM-dd"), F.lit(" 16:00:00"))), "America/New_York")
            rows = rows.join(given, _KEY, "left").withColumn("_ok", F.coalesce(finite(F.col("_iv")) & (F.col("_iv") > 0) & (F.col("observed_at") <= closing), F.lit(False)))
            if strict and rows.where("priceable and not _ok").limit(1).count():
                raise BacktestError("observations must be finite, positive and available by the entry close; check their timestamps")
        tau = implied_vol_days * cfg.dt if implied_vol_days is not None else front_tau
        jump = F.greatest(F.lit(0.0), (F.col("_iv") * F.col("_iv") - F.col("baseline") * F.col("baseline")) * tau)
        rows = rows.withColumn("_use", F.col("priceable") & F.col("_ok")).withColumn("jump_var", jump)
    skipped = rows.groupBy("ticker").agg(F.count(F.when(~F.col("_use"), 1)).alias("n_skipped"), F.count(F.when(F.col("_use"), 1)).alias("n_traded"))
    used = rows.where("_use")
    if strict and used.limit(1).count() == 0:
        raise BacktestError("no event has enough surrounding or prior calibration history")
    calendar = cfg.structure == "calendar"

    known = [c for c in used.columns if c not in (*_KEY, "path")]
    path = used.select(*_KEY, *known, F.posexplode("path").alias("t", "spot"))
    legs = {"front": (cfg.entry_offset + cfg.front_expiry_offset, F.col("baseline"), F.col("jump_var"))}
    if calendar:
        legs["back"] = (cfg.entry_offset - cfg.back_expiry_offset, F.col("baseline") * cfg.back_iv_multiplier, F.lit(0.0))
    path = _revalued(path, legs, last, cfg)
    path = path.withColumns({"front_step": _pnl("front"), "back_step": _pnl("back") if calendar else F.lit(0.0)})
    start = F.col("t") == 0

    def at_entry(column: str) -> Column:
        return F.max(F.when(start, F.col(column)))

    sums = [(-F.sum("front_step")).alias("front_pnl"), at_entry("front_value").alias("front_premium"), at_entry("front_sigma").alias("front_iv")]
    if calendar:
        sums += [F.sum("back_step").alias("back_pnl"), at_entry("back_value").alias("back_premium"), at_entry("back_sigma").alias("back_iv")]
    else:
        sums += [F.lit(0.0).alias("back_pnl"), F.lit(0.0).alias("back_premium"), F.lit(None).cast("double").alias("back_iv")]
    trades = path.groupBy(*_KEY).agg(*sums, *[F.first(c).alias(c) for c in known])

    spot, slip = F.col("entry_spot"), cfg.slippage_vol_points
    orders = {"front_sale": (spot, spot, F.greatest(F.col("front_iv") - slip, F.lit(1e-6)), F.lit(front_tau))}
    if calendar:
        orders["back_buy"] = (spot, spot, F.col("back_iv") + slip, F.lit((cfg.entry_offset - cfg.back_expiry_offset) * cfg.dt))
    trades = with_straddles(trades, orders, cfg.rate)
    trades = trades.withColumns({"front_entry_execution": F.col("front_sale.price"), "back_entry_execution": F.col("back_buy.price") if calendar else F.lit(0.0)})
    front_gap = F.col("front_entry_execution") - F.col("front_premium")
    trades = trades.withColumns(
        {
            "execution_adjustment": front_gap - (F.col("back_entry_execution") - F.col("back_premium")),
            "net_credit": F.col("front_entry_execution") - F.col("back_entry_execution"),
            "model_gross_pnl": F.col("front_pnl") + F.col("back_pnl"),
            "cost": (F.col("front_premium") + F.col("back_premium")) * (cfg.transaction_cost_bps / 10_000),
        }
    )
    trades = trades.withColumn("net_pnl", F.col("model_gross_pnl") + F.col("execution_adjustment") - F.col("cost"))
    bases = {
        "front_premium": F.col("front_premium"),
        "net_credit": F.when(F.abs("net_credit") < 0.05 * F.col("front_premium"), F.col("front_premium") + F.col("back_premium")).otherwise(F.abs("net_credit")),
        "notional": spot,
    }
    trades = trades.withColumn("capital_basis", bases[cfg.capital_basis])
    trades = trades.withColumn("return", F.when(F.col("capital_basis") > 0, F.col("net_pnl") / F.col("capital_basis")))
    trades = trades.withColumns(
        {
            "sigma_baseline": F.col("baseline"),
            "implied_event_move": F.sqrt("jump_var") * SQRT_2_OVER_PI,
            "entry_baseline_date": F.col("entry_date"),
            "strike": spot,
            "realized_move": F.col("abs_event_return"),
        }
    )
    trades = trades.select(*_KEY, *TRADE_COLUMNS)
    if strict:
        if trades.where("capital_basis is null or capital_basis <= 0").limit(1).count():
            raise BacktestError("a capital basis is not positive")
        if cfg.compound and trades.where(F.col("return") <= -1).limit(1).count():
            raise BacktestError("returns at or below -100% cannot be compounded")
    return BacktestResult(trades, skipped, bars, events, cfg, source)


def _with_curve(trades: DataFrame, compound: bool) -> DataFrame:
    """Trades with equity, its peak, the drawdown and the days since the trade before, in one pass by ticker.

    Compounded equity ends, as null, with a return of -100 % or less.
    """
    so_far = _by_event().rowsBetween(Window.unboundedPreceding, 0)
    r = F.col("return")
    grown = F.when(F.min(r).over(so_far) > -1, F.product(1 + r).over(so_far)) if compound else 1 + F.sum(r).over(so_far)
    df = trades.withColumns({"equity": grown, "gap": F.datediff("session_date", F.lag("session_date").over(_by_event()))})
    df = df.withColumn("peak", F.when(F.col("equity").isNotNull(), F.greatest(F.lit(1.0), F.max("equity").over(so_far))))
    return df.withColumn("drawdown", F.col("equity") / F.col("peak") - 1 if compound else F.col("equity") - F.col("peak"))


def equity_curve(trades: DataFrame, compound: bool = False) -> DataFrame:
    """``(ticker, session_date, return, equity, peak, drawdown)``; the peak starts at 1."""
    return _with_curve(trades, compound).select(*_KEY, "return", "equity", "peak", "drawdown")


def _rate(n: Column, gap: Column, default: float) -> Column:
    middle = F.median(F.when(gap > 0, gap))
    return F.when((n >= 3) & middle.isNotNull(), F.least(F.lit(12.0), F.greatest(F.lit(1.0), 365.25 / middle))).otherwise(F.lit(float(default)))


def events_per_year(dates: DataFrame, default: float = 4.0) -> DataFrame:
    """Per ticker, 365.25 by the median gap of ``session_date``, between 1 and 12; ``default`` below three dates."""
    gap = F.datediff("session_date", F.lag("session_date").over(_by_event()))
    gaps = dates.select(*_KEY).distinct().withColumn("gap", gap)
    return gaps.groupBy("ticker").agg(_rate(F.count(F.lit(1)), F.col("gap"), default).alias("events_per_year"))


def trade_stats(trades: DataFrame, cfg: BacktestConfig | None = None) -> DataFrame:
    """Performance figures by ticker, from one pass over the trades and one aggregation.

    A curve that ends has neither drawdown nor total return.
    """
    cfg = cfg or BacktestConfig()
    unbroken = F.count("equity") == F.count(F.lit(1))
    r = F.col("return")
    n, mean = F.count(r), F.avg(r)
    sd = F.when(n > 1, F.stddev_samp(r)).otherwise(F.lit(0.0))
    won, lost = F.coalesce(F.sum(F.when(r > 0, r)), F.lit(0.0)), F.coalesce(F.sum(F.when(r < 0, -r)), F.lit(0.0))
    rate = F.lit(float(cfg.events_per_year)) if cfg.events_per_year else _rate(F.count(F.lit(1)), F.col("gap"), 4.0)
    out = _with_curve(trades, cfg.compound).groupBy("ticker").agg(
        n.cast("double").alias("n_trades"),
        F.avg((r > 0).cast("double")).alias("win_rate"),
        mean.alias("mean_return"),
        F.median(r).alias("median_return"),
        sd.alias("std_return"),
        F.when(lost > 0, won / lost).when(won > 0, F.lit(float("inf"))).alias("profit_factor"),
        F.max(r).alias("best_trade"),
        F.min(r).alias("worst_trade"),
        *[F.avg(c).alias(f"mean_{c}") for c in ("net_credit", "front_pnl", "back_pnl", "cost")],
        F.avg("implied_event_move").alias("mean_implied_move"),
        F.avg("realized_move").alias("mean_realized_move"),
        F.when(unbroken, F.least(F.lit(0.0), F.min("drawdown"))).alias("max_drawdown"),
        F.when(unbroken, F.max_by("equity", "session_date") - 1).alias("total_return"),
        rate.alias("events_per_year"),
    )
    sharpe = F.when(F.col("std_return") > 0, F.col("mean_return") / F.col("std_return") * F.sqrt("events_per_year"))
    return out.withColumn("sharpe_ratio", sharpe)


_SHOWN = {
    "n_trades": ("trades", "%.0f"), "win_rate": ("win rate", "%.1f%%"), "mean_return": ("mean return", "%.2f%%"), "median_return": ("median return", "%.2f%%"),
    "sharpe_ratio": ("Sharpe ratio", "%.2f"), "profit_factor": ("profit factor", "%.2f"), "max_drawdown": ("largest drawdown", "%.2f%%"), "total_return": ("total return", "%.2f%%"),
}


def summary_table(stats: DataFrame) -> DataFrame:
    """``(ticker, place, figure, value)``: the figures for people, as text; what is not defined is ``n/a``."""
    lines = []
    for place, (name, (label, style)) in enumerate(_SHOWN.items()):
        value = F.col(name) * 100 if "%%" in style else F.col(name)
        text = F.when(F.col(name).isNull() | F.isnan(name), "n/a").when(F.abs(name) == float("inf"), F.when(F.col(name) > 0, "inf").otherwise("-inf")).otherwise(F.format_string(style, value))
        lines.append(F.struct(F.lit(place).alias("place"), F.lit(label).alias("figure"), text.alias("value")))
    return stats.select("ticker", F.inline(F.array(*lines)))
