"""Command line: decomposition, premium and backtest of any number of tickers.

All tickers run in one job per table; a ticker whose bars break the rules is a
row of the status table, not an exception.
"""

from __future__ import annotations

import argparse
import logging
import operator
import sys
from collections.abc import Callable
from datetime import date
from typing import Any

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .config import ESTIMATORS, STRUCTURES, BacktestConfig, DecompositionConfig
from .errors import VarsightError
from .operators import alignment, backtest, cone, counters, decomposition, premium, quality, report
from .session import build_session
from .sources import store, tables

log = logging.getLogger("varsight")
CLAMP_WARNING = 0.30
CHART_FORMATS = ("parquet", "csv", "json")

# Flags that fill a setting: the configuration, its field and how the flag's value becomes the field's.
_FILLS: dict[str, tuple[type, str, Callable]] = {
    "--baseline-windows": (DecompositionConfig, "baseline_windows", tuple),
    "--event-window": (DecompositionConfig, "event_window", int),
    "--post-windows": (DecompositionConfig, "post_windows", tuple),
    "--estimator": (DecompositionConfig, "estimator", str),
    "--baseline-gap": (DecompositionConfig, "baseline_gap", int),
    "--announcement-offset": (DecompositionConfig, "announcement_offset", int),
    "--no-annualize": (DecompositionConfig, "annualized", operator.not_),
    "--structure": (BacktestConfig, "structure", str),
    "--entry-offset": (BacktestConfig, "entry_offset", int),
    "--exit-offset": (BacktestConfig, "exit_offset", int),
    "--iv-multiplier": (BacktestConfig, "implied_move_multiplier", float),
    "--cost-bps": (BacktestConfig, "transaction_cost_bps", float),
    "--slippage-vol": (BacktestConfig, "slippage_vol_points", float),
}
_CHOICES = {"--estimator": ESTIMATORS, "--structure": STRUCTURES}


def _add_settings(group: argparse._ArgumentGroup, config: type) -> None:
    """The flags that fill ``config``, with its fields' defaults."""
    defaults = config()
    for flag, (owner, name, _) in _FILLS.items():
        if owner is not config:
            continue
        held = getattr(defaults, name)
        if isinstance(held, bool):
            group.add_argument(flag, action="store_true")
        elif isinstance(held, tuple):
            group.add_argument(flag, type=type(held[0]), nargs="+", default=list(held))
        else:
            group.add_argument(flag, type=type(held), default=held, choices=_CHOICES.get(flag))


def settings(args: argparse.Namespace, config: type) -> Any:
    """The configuration that the flags ask for."""
    given = {name: turn(getattr(args, flag[2:].replace("-", "_"))) for flag, (owner, name, turn) in _FILLS.items() if owner is config}
    return config(**given)


def decomposition_config(args: argparse.Namespace) -> DecompositionConfig:
    return DecompositionConfig.prototype() if args.prototype_mode else settings(args, DecompositionConfig)


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="varsight", description="Variance of prices around events, on Spark.")
    p.add_argument("--version", action="version", version=f"%(prog)s {__version__}")
    d = p.add_argument_group("data")
    d.add_argument("-t", "--ticker", "--tickers", dest="tickers", nargs="+", default=[], metavar="TICKER")
    d.add_argument("--universe-csv", help="CSV with a ticker, symbol or tickers column")
    d.add_argument("--prices-csv", help="CSV of bars; needs --earnings-csv")
    d.add_argument("--prices-parquet", help="Parquet of bars with a ticker column")
    d.add_argument("--years", type=float, default=7)
    d.add_argument("--start", type=date.fromisoformat)
    d.add_argument("--end", type=date.fromisoformat)
    d.add_argument("--earnings-csv", help="CSV of event dates")
    d.add_argument("--earnings-limit", type=int, default=40)
    d.add_argument("--cache-dir", help="store of bars and events: read where it is fresh, else filled from the files")
    d.add_argument("--cache-hours", type=float, default=24, help="age from which stored rows that reach to yesterday are read anew")
    d.add_argument("--refresh", action="store_true", help="read anew what the store holds")
    d.add_argument("--no-cache", action="store_true")
    d.add_argument("--clear-cache", action="store_true")
    d.add_argument("--strict-gaps", action="store_true")
    m = p.add_argument_group("decomposition")
    _add_settings(m, DecompositionConfig)
    m.add_argument("--prototype-mode", action="store_true")
    v = p.add_argument_group("premium")
    v.add_argument("--implied-vol", type=float, help="constant implied volatility in percent")
    v.add_argument("--iv-days", type=int, default=21)
    v.add_argument("--trim", type=float, default=0.05)
    b = p.add_argument_group("backtest")
    b.add_argument("--no-backtest", action="store_true")
    _add_settings(b, BacktestConfig)
    o = p.add_argument_group("output")
    o.add_argument("--plot", action="store_true", help="write the data of the charts")
    o.add_argument("--backend", choices=CHART_FORMATS, default="parquet", help="format of the charts' data; none draws")
    o.add_argument("--outdir", default="output")
    o.add_argument("--save-csv", action="store_true")
    o.add_argument("--show-events", action="store_true")
    o.add_argument("--summary-only", action="store_true")
    o.add_argument("--fail-fast", action="store_true")
    o.add_argument("-v", "--verbose", action="store_true")
    o.add_argument("-q", "--quiet", action="store_true")
    return p


def resolve_tickers(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    named = [t.strip().upper() for t in args.tickers if t.strip()]
    if args.universe_csv:
        named += tables.read_universe(spark, args.universe_csv)
    return list(dict.fromkeys(named))


def _inputs(spark: SparkSession, args: argparse.Namespace, tickers: list[str]) -> tuple[DataFrame, DataFrame]:
    """Raw bars and event dates: of files, or of the store, which files fill where it is stale."""
    one = tickers[0] if len(tickers) == 1 else None
    root = None if args.no_cache else args.cache_dir
    start, end = args.start, args.end
    from_file = args.prices_csv or args.prices_parquet
    if root and start is None:
        start, end = tables.default_range(args.years, end)

    def read_prices() -> DataFrame:
        raw = tables.read_price_csv(spark, args.prices_csv, one) if args.prices_csv else tables.read_price_parquet(spark, args.prices_parquet)
        return raw.withColumns({"ticker": F.upper(F.trim("ticker")), "date": F.to_date("date")})

    def read_events() -> DataFrame:
        return tables.read_event_csv(spark, args.earnings_csv, one)

    def stored(kind: str, read: Callable[[], DataFrame] | None) -> DataFrame:
        if read is None or not tickers:
            return store.read_store(spark, root, kind, tickers or None)
        return store.through_store(spark, root, kind, tickers, start, end or date.today(), read, ttl_hours=args.cache_hours, force_refresh=args.refresh)

    if not (from_file or root):
        raise VarsightError("name a source of prices: --prices-csv, --prices-parquet or --cache-dir")
    if not (args.earnings_csv or root):
        raise VarsightError("name a source of event dates: --earnings-csv or --cache-dir")
    raw = stored("prices", read_prices if from_file else None) if root else read_prices()
    events = stored("events", read_events if args.earnings_csv else None) if root else read_events()
    if not args.earnings_csv:
        events = tables.load_events(events, limit=args.earnings_limit)
    if tickers:
        raw = raw.where(F.upper("ticker").isin(tickers))
    if start:
        raw = raw.where(F.to_date("date") >= F.lit(start))
    if end:
        raw = raw.where(F.to_date("date") <= F.lit(end))
    return raw, events


def number(value: float | None, percent: bool = False, digits: int = 2) -> str:
    """A figure for people: ``n/a``, ``inf``, ``-inf`` or rounded, with a sign for percent."""
    if value is None or value != value:
        return "n/a"
    if value in (float("inf"), float("-inf")):
        return "inf" if value > 0 else "-inf"
    return f"{value * 100:.{digits}f}%" if percent else f"{value:.{digits}f}"


def _section(title: str, rows: list[tuple[str, str]]) -> None:
    print(f"\n{title}\n" + "-" * len(title))
    for name, value in rows:
        print(f"  {name:<28}{value:>14}")


def _report(rows: list[Row], source: str) -> None:
    for done in sorted((r for r in rows if r["summary"] is not None), key=lambda r: r["ticker"]):
        t, row = done["ticker"], done["summary"]
        _section(
            f"{t}: {row['n_events']} events",
            [
                ("mean baseline volatility", number(row["mean_sigma_baseline"], True)),
                ("mean jump volatility", number(row["mean_sigma_jump"], True)),
                ("mean total volatility", number(row["mean_sigma_total"], True)),
                ("mean largest move", number(row["mean_abs_event_return"], True)),
                ("mean variance ratio", number(row["mean_variance_ratio"])),
                ("clamped", number(row["clamp_rate"], True)),
            ],
        )
        print(f"  events: {done['placed'] or 'none'}")
        if row["clamp_rate"] is not None and row["clamp_rate"] > CLAMP_WARNING:
            print(f"  warning: {number(row['clamp_rate'], True)} of the jumps were clamped at zero")
        if done["premium"] is not None:
            v = done["premium"]
            _section("premium", [("mean", number(v["mean_vrp"], True)), ("median", number(v["median_vrp"], True)), ("hit rate", number(v["hit_rate"], True)), ("t", number(v["t_stat"]))])
            print(f"  implied moves: {source}")
        if done["stats"] is not None:
            s = done["stats"]
            _section(
                "backtest",
                [("trades", number(s["n_trades"], digits=0)), ("win rate", number(s["win_rate"], True)), ("mean return", number(s["mean_return"], True)), ("Sharpe", number(s["sharpe_ratio"])), ("drawdown", number(s["max_drawdown"], True))],
            )
    for done in sorted((r for r in rows if r["failure"] is not None), key=lambda r: r["ticker"]):
        print(f"\n{done['ticker']}: failed: {done['failure']}")


def analyze(spark: SparkSession, args: argparse.Namespace) -> int:
    """Run the stages; the number of tickers that failed one they needed.

    The stages' outcome is written before a backtest that cannot run raises.
    """
    cfg = decomposition_config(args)
    bt = None if args.no_backtest else settings(args, BacktestConfig)
    tickers = resolve_tickers(spark, args)
    raw, announcements = _inputs(spark, args, tickers)
    bars_in, seen_bars = counters.observe_bars(quality.coerce_bars(raw))
    verdict = quality.with_verdict(quality.violations(bars_in), min_rows=cfg.back_need + cfg.forward_need + 1).select("ticker", "valid", "problems").persist()
    asked = spark.createDataFrame([(t,) for t in tickers], "ticker string")
    everyone = verdict.select("ticker").union(asked).distinct().join(verdict, "ticker", "left")
    unfit = F.when(F.col("valid").isNull(), F.lit("no bars")).when(~F.col("valid"), F.concat_ws("; ", "problems"))
    everyone = everyone.select("ticker", unfit.alias("unfit"))
    if args.fail_fast:
        first = everyone.where("unfit is not null").orderBy("ticker").first()
        if first:
            raise VarsightError(f"{first['ticker']}: {first['unfit']}")
    bars = bars_in.dropna(subset=list(quality.PRICES)).join(verdict.where("valid"), "ticker", "left_semi")
    if args.strict_gaps:
        gaps = quality.detect_gaps(bars)
        everyone = everyone.join(quality.describe_gaps(gaps), "ticker", "left").select("ticker", F.coalesce("unfit", "description").alias("unfit"))
        bars = bars.join(gaps, "ticker", "left_anti")
    bars = bars.persist()
    events = decomposition.decompose_events(bars, announcements, cfg).persist()
    try:
        return _deliver(args, cfg, bt, bars, announcements, events, everyone, seen_bars)
    finally:
        events.unpersist()
        bars.unpersist()
        verdict.unpersist()


def _deliver(
    args: argparse.Namespace, cfg: DecompositionConfig, bt: BacktestConfig | None, bars: DataFrame, announcements: DataFrame, events: DataFrame, everyone: DataFrame, seen_bars: Observation
) -> int:
    """One job makes a row per ticker of all stages; each table that was asked for is one more.

    Counts come from the jobs themselves.  Rows of tickers reach the driver only where they are printed.
    """
    summary = decomposition.summarize(events)
    iv = None if args.implied_vol is None else args.implied_vol / 100
    vrp = premium.volatility_risk_premium(events, implied_vols=iv, days_to_expiry=args.iv_days, trim_quantile=args.trim, annualized=cfg.annualized)
    result, broken, stats = None, None, None
    if bt is not None:
        stats = everyone.sparkSession.createDataFrame([], "ticker string")
        try:
            result = backtest.run_backtest(bars, events, bt, cfg, implied_vols=iv, implied_vol_days=args.iv_days if iv else None, strict=False)
        except VarsightError as e:
            broken = e
    why = F.lit("no event with enough history to trade")
    if result is not None:
        result.trades.persist()
        problems = result.problems.groupBy("ticker").agg(F.array_join(F.sort_array(F.collect_set("problem")), "; ").alias("problem"))
        stats = result.stats.join(problems, "ticker", "left_anti")
        everyone, why = everyone.join(problems, "ticker", "left"), F.coalesce("problem", why)
    aligned, seen_aligned = counters.observe_alignment(alignment.align_events(bars, announcements, cfg))
    done = report.outcomes(everyone, summary, vrp.stats, stats).join(alignment.describe(aligned), "ticker", "left")
    failure = F.when(F.col("unfit").isNotNull(), F.col("unfit")).when(F.col("stages.decomposition") == "failed", F.lit("no event could be aligned")).when(F.col("stages.backtest") == "failed", why)
    done = done.select("ticker", "stages", "summary", "premium", "stats", F.col("description").alias("placed"), failure.alias("failure")).persist()
    try:
        counted, seen = counters.observe_stages(done)
        told = not args.quiet and not args.summary_only
        if told:
            rows = counted.collect()
        else:
            counted.write.format("noop").mode("overwrite").save()
        if args.save_csv:
            store.write_csv(events, f"{args.outdir}/events")
            store.write_csv(alignment.align_events(bars, announcements, cfg), f"{args.outdir}/alignment")
            if result is not None:
                store.write_csv(result.trades, f"{args.outdir}/trades")
            store.write_stages(done.select("ticker", "stages"), f"{args.outdir}/stages")
        if broken is not None:
            raise broken
        log.info("bars %s, announcements %s, tickers %s", seen_bars.get, seen_aligned.get, seen.get)
        if told:
            _report(rows, vrp.source)
        if args.show_events and not args.quiet:
            report.event_table(events).orderBy("ticker", "place").show(200, truncate=False)
        if result is not None and not args.quiet and seen.get["n_decomposition_ok"] > 1:
            report.cross_section(summary, result.stats).show(200, truncate=False)
        _charts(args, bars, events, vrp.per_event, result)
        return seen.get["n_failed"]
    finally:
        done.unpersist()
        if result is not None:
            result.trades.unpersist()


def _charts(args: argparse.Namespace, bars: DataFrame, events: DataFrame, per_event: DataFrame, result: backtest.BacktestResult | None) -> None:
    if args.plot:
        charts = {"cone": cone.vol_cone(bars, estimator=args.estimator), "jumps": report.jump_histogram(events), "timeline": report.decomposition_timeline(events), "premium": report.premium_scatter(per_event)}
        if result is not None:
            charts["pnl"] = report.pnl_chart(result.equity)
        for name, df in charts.items():
            df.write.mode("overwrite").format(args.backend).options(**({"header": True} if args.backend == "csv" else {})).save(f"{args.outdir}/charts/{name}")


def main(argv: list[str] | None = None) -> int:
    """0 if all went well, 1 if a ticker failed, 2 for wrong usage, 130 if interrupted."""
    parser = build_parser()
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if args.verbose else logging.ERROR if args.quiet else logging.WARNING)
    if args.prices_csv and not args.earnings_csv:
        print("--prices-csv needs --earnings-csv", file=sys.stderr)
        return 2
    spark = SparkSession.getActiveSession() or build_session()
    try:
        if args.clear_cache and args.cache_dir:
            log.warning("removed %d stored tables", store.clear_store(spark, args.cache_dir))
        if not (args.tickers or args.universe_csv or args.prices_csv or args.prices_parquet):
            if args.clear_cache:
                return 0
            print("name tickers or a file of bars", file=sys.stderr)
            return 2
        return 1 if analyze(spark, args) else 0
    except KeyboardInterrupt:
        return 130
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    except VarsightError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
