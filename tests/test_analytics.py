"""Decomposition, premium and backtest against closed forms and golden numbers."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import ohlcv, sample_history
from varsight.config import BacktestConfig, DecompositionConfig
from varsight.errors import AlignmentError, BacktestError, InsufficientDataError, MissingEventsError, SchemaError
from varsight.functions import expressions as X
from varsight.operators import alignment, backtest, cone, decomposition, estimators, premium, quality, report

GOLD = {
    "2023-05-02": (85, 0.4618476656, 0.0788623977, 0.4550648179, 34.2971120083, 0.0818850422, 0.04, 0.0496375861),
    "2023-10-25": (211, 0.2807210101, 0.0819563606, 0.2684910436, 11.7323363801, 0.0794150737, 0.025, 0.0256563822),
    "2024-10-11": (463, 0.6185047843, 0.0790146234, 0.6134369222, 61.2732868609, 0.0862664253, -0.055, -0.0583311519),
}
GOLD_TRADES = {
    "2023-10-25": ("2023-10-18", 2, 0.0790402715, 0.05, 0.3604824202, 5.0545982707, 0.5542359977, 2.7544760897, 0.0443697469, 0.5509485822),
    "2024-10-11": ("2024-10-04", 6, 0.0789781797, 0.0466666667, 0.3376302429, 4.7022191046, 0.5500513445, -0.5081941459, 0.4091355012, -0.0238588033),
}


@pytest.fixture(scope="module")
def events(sample):
    return decomposition.decompose_events(*sample).cache()


@pytest.fixture(scope="module")
def result(sample, events):
    return backtest.run_backtest(sample[0], events, strict=True)


def test_decomposition_golden(events):
    rows = {str(r["session_date"]): r for r in events.collect()}
    assert len(rows) == 7
    for day, (p, total, base, jump, ratio, post, move, whole) in GOLD.items():
        r = rows[day]
        got = (r["sigma_total"], r["sigma_baseline"], r["sigma_jump"], r["variance_ratio"], r["sigma_post_5"], r["event_return"], r["event_window_log_return"])
        assert r["return_position"] == p
        np.testing.assert_allclose(got, (total, base, jump, ratio, post, move, whole), rtol=1e-8)


def test_published_means(events):
    s = decomposition.summarize(events).first()
    assert round(100 * s["mean_sigma_baseline"], 2) == 8.13
    assert round(100 * s["mean_sigma_jump"], 2) == 53.35
    assert round(100 * s["mean_abs_event_return"], 2) == 4.79


def test_trades_golden(result):
    rows = {str(r["session_date"]): r for r in result.trades.collect()}
    assert len(rows) == 5 and result.skipped.first()["n_skipped"] == 2
    for day, (entry, history, base, move, iv, front, back, front_pnl, back_pnl, ret) in GOLD_TRADES.items():
        r = rows[day]
        assert (str(r["entry_date"]), r["history_events"]) == (entry, history)
        got = (r["sigma_baseline"], r["implied_event_move"], r["front_iv"], r["front_premium"], r["back_premium"], r["front_pnl"], r["back_pnl"], r["return"])
        np.testing.assert_allclose(got, (base, move, iv, front, back, front_pnl, back_pnl, ret), rtol=1e-8)


def test_stats_golden(result):
    s = result.stats.first()
    gold = {"win_rate": 0.6, "mean_return": 0.0700212126, "median_return": 0.066676216, "std_return": 0.5530684489, "sharpe_ratio": 0.2579315809, "profit_factor": 1.4268779399, "max_drawdown": -0.7962961645, "total_return": 0.350106063, "events_per_year": 4.1505681818}
    np.testing.assert_allclose([s[k] for k in gold], list(gold.values()), rtol=1e-8)


def test_one_shuffle_by_ticker(sample):
    """Frames and as-of step share the exchange on the ticker; no join is a cartesian product."""
    plan = decomposition.session_variances(sample[0], DecompositionConfig())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(ticker") == 1
    full = decomposition.decompose_events(*sample)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in full and "NestedLoop" not in full and "Python" not in full


def test_identity_of_variances(sample):
    raw = decomposition.decompose_events(*sample, DecompositionConfig(annualized=False)).toPandas()
    np.testing.assert_allclose(raw.sigma_total**2 - raw.sigma_baseline**2, raw.var_jump_raw, rtol=1e-9)
    year = decomposition.decompose_events(*sample).toPandas()
    np.testing.assert_allclose(year.sigma_jump, raw.sigma_jump * math.sqrt(252), rtol=1e-12)
    np.testing.assert_allclose(year.var_jump_raw, raw.var_jump_raw, rtol=1e-12)


def test_quiet_events_are_clamped(spark):
    r = np.random.default_rng(3).normal(0, 0.03, 400)
    r[[200, 201, 300, 301]] = 1e-6
    bars = ohlcv(r)
    ev = spark.createDataFrame([("AAA", bars.date[i + 1]) for i in (200, 300)], "ticker string, announcement_date date")
    out = decomposition.decompose_events(spark.createDataFrame(bars), ev).toPandas()
    assert out.jump_clamped.all() and (out.sigma_jump == 0).all() and (out.var_jump_raw < 0).all()


def test_prototype_misses_twin_moves(spark):
    """Two equal moves have no spread about their mean, so the old convention sees no jump."""
    r = np.random.default_rng(1).normal(0, 0.005, 500)
    for p in (200, 300):
        r[p] = r[p + 1] = 0.09
    bars = ohlcv(r)
    ev = spark.createDataFrame([("AAA", bars.date[p + 1]) for p in (200, 300)], "ticker string, announcement_date date")
    old = decomposition.decompose_events(spark.createDataFrame(bars), ev, DecompositionConfig.prototype()).toPandas()
    new = decomposition.decompose_events(spark.createDataFrame(bars), ev).toPandas()
    assert (old.sigma_total < 1e-12).all() and (new.sigma_jump > 1).all()


def test_alignment_rolls_and_dedupes(spark):
    bars = spark.createDataFrame(ohlcv(np.random.default_rng(0).normal(0, 0.01, 200)))
    days = [dt.date(2019, 6, 15), dt.date(2019, 6, 16), dt.date(2030, 1, 1), dt.date(2019, 1, 4), None]
    ev = spark.createDataFrame([("AAA", d) for d in days], "ticker string, announcement_date date")
    rows = {r["announcement_date"]: r for r in alignment.align_events(bars, ev).collect()}
    assert rows[days[0]]["status"] == "aligned" and rows[days[0]]["session_date"] == dt.date(2019, 6, 17)
    assert rows[days[1]]["status"] == "duplicate"
    assert rows[days[2]]["status"] == "future" and rows[days[3]]["status"] == "insufficient"
    assert len(rows) == 4
    with pytest.raises(AlignmentError, match="strict"):
        alignment.align_events(bars, ev, strict=True)
    with pytest.raises(MissingEventsError):
        alignment.align_events(bars, ev.where("announcement_date > '2029-01-01'"), strict=True)


def test_offset_moves_the_session(sample):
    a = alignment.aligned_events(*sample).toPandas()
    b = alignment.aligned_events(*sample, DecompositionConfig(announcement_offset=1)).toPandas()
    assert (b.set_index("announcement_date").return_position - a.set_index("announcement_date").return_position == 1).all()


@pytest.mark.parametrize("estimator", ["close_to_close", "parkinson", "yang_zhang"])
def test_rolling_matches_pandas(spark, estimator):
    bars = ohlcv(np.random.default_rng(7).normal(0, 0.02, 80))
    w = 15
    got = estimators.REGISTRY[estimator][1](spark.createDataFrame(bars), w).orderBy("date").toPandas().sigma
    b = bars.set_index("date")
    if estimator == "close_to_close":
        want = np.log(b.close).diff().rolling(w).std()
    elif estimator == "parkinson":
        want = np.sqrt((np.log(b.high / b.low) ** 2).rolling(w).mean() / (4 * np.log(2)))
    else:
        o, c = np.log(b.open / b.close.shift()), np.log(b.close / b.open)
        u, d = np.log(b.high / b.open), np.log(b.low / b.open)
        k = 0.34 / (1.34 + (w + 1) / (w - 1))
        want = np.sqrt((o.rolling(w).var() + k * c.rolling(w).var() + (1 - k) * (u * (u - c) + d * (d - c)).rolling(w).mean()).clip(lower=0))
    np.testing.assert_allclose(got.to_numpy(dtype=float), want.to_numpy() * math.sqrt(252), rtol=1e-9)


def test_parkinson_closed_form(spark):
    bars = ohlcv(np.zeros(30))
    bars["high"], bars["low"] = bars.close * math.exp(0.01), bars.close * math.exp(-0.01)
    sigma = estimators.parkinson(spark.createDataFrame(bars), annualized=False).first()["sigma"]
    assert sigma == pytest.approx(0.02 / math.sqrt(4 * math.log(2)), rel=1e-12)


def test_estimators_need_history(spark):
    bars = spark.createDataFrame(ohlcv(np.array([0.01])))
    assert estimators.close_to_close(bars).first()["sigma"] is None
    with pytest.raises(InsufficientDataError):
        estimators.close_to_close(bars, strict=True)
    with pytest.raises(ValueError):
        estimators.rolling_close_to_close(bars, 1)


def test_validation_rules(spark):
    good = ohlcv(np.random.default_rng(0).normal(0, 0.01, 30))
    cases = {"non-positive": ("low", -1.0), "High < Low": ("high", 0.5), "negative volume": ("volume", -5.0)}
    for text, (column, value) in cases.items():
        bad = good.copy()
        bad.loc[4, column] = value
        with pytest.raises(SchemaError, match=text):
            quality.validate_ohlcv(spark.createDataFrame(bad))
    with pytest.raises(SchemaError, match="duplicated"):
        quality.validate_ohlcv(spark.createDataFrame(pd.concat([good, good.iloc[:1]])))
    with pytest.raises(SchemaError, match="missing"):
        quality.validate_ohlcv(spark.createDataFrame(good.drop(columns="open")))
    with pytest.raises(SchemaError, match="empty"):
        quality.validate_ohlcv(spark.createDataFrame(good).limit(0))
    holed = good.copy()
    holed.loc[3, "close"] = float("nan")
    assert quality.validate_ohlcv(spark.createDataFrame(holed)).count() == 30
    both = pd.concat([good, bad.assign(ticker="BBB")])
    kept = quality.validate_ohlcv(spark.createDataFrame(both), strict=False)
    assert [r["ticker"] for r in kept.select("ticker").distinct().collect()] == ["AAA"]


def test_gaps(spark):
    bars = ohlcv(np.zeros(100))
    short = spark.createDataFrame(pd.concat([bars[:40], bars[43:]]))
    assert quality.detect_gaps(short).count() == 0
    long = quality.detect_gaps(spark.createDataFrame(pd.concat([bars[:40], bars[60:]]))).collect()
    assert len(long) == 1 and long[0]["n_days"] == 20
    weekend = bars.iloc[[45]].assign(date=dt.date(2019, 3, 9))
    assert quality.detect_gaps(spark.createDataFrame(pd.concat([bars[:40], weekend, bars[60:]]))).first()["n_days"] == 20


def test_normal_distribution(spark):
    xs = [float(x) for x in np.arange(-10, 10, 0.01)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    one = df.select(X.norm_cdf(F.col("x")).alias("p")).toPandas().p
    two = X.with_norm_cdf(df, "x", "p").toPandas().p
    want = np.array([0.5 * math.erfc(-x / math.sqrt(2)) for x in xs])
    np.testing.assert_allclose(one, want, atol=1e-15)
    np.testing.assert_array_equal(one, two)
    X.register_sql_functions(spark)
    assert spark.sql("SELECT norm_cdf(1.0D)").first()[0] == pytest.approx(0.8413447460685429, abs=1e-15)


def test_straddle(spark):
    df = spark.createDataFrame([(90.0, 0.0), (100.0, 0.0), (110.0, 0.0), (100.0, 0.25)], "s double, tau double")
    args = (F.col("s"), F.lit(100.0), F.lit(0.2), F.col("tau"))
    rows = df.select(X.bs_straddle(*args).alias("b")).select("b.*").collect()
    assert [tuple(r) for r in rows[:3]] == [(10.0, -1.0, 0.0), (0.0, 0.0, 0.0), (10.0, 1.0, 0.0)]
    assert rows[3]["price"] == pytest.approx(2 * 100 * (2 * 0.5 * math.erfc(-0.05 / math.sqrt(2)) - 1), rel=1e-12)
    staged = X.with_straddle(df, "b", *args).select("b.*").collect()
    assert [tuple(r) for r in rows] == [tuple(r) for r in staged]
    bad = spark.createDataFrame([(-1.0, 0.1), (float("nan"), 0.1), (100.0, -0.1)], "s double, tau double")
    assert all(r["b"] is None for r in bad.select(X.bs_straddle(*args).alias("b")).collect())
    with pytest.raises(Exception, match="strictly positive"):
        bad.select(X.bs_straddle(*args, strict=True).alias("b")).collect()


def test_premium(sample, events):
    proxy = premium.volatility_risk_premium(events)
    assert proxy.source == "historical_proxy"
    assert proxy.stats.first()["mean_vrp"] == pytest.approx(0, abs=1e-12)
    rich = premium.volatility_risk_premium(events, implied_moves=0.15).stats.first()
    assert rich["hit_rate"] == 1 and rich["n_trimmed"] == 2 and rich["n_events"] == 7
    given = events.select("ticker", "session_date", F.lit(0.02).alias("implied_move")).where("session_date < '2024-08-01'")
    some = premium.volatility_risk_premium(events, implied_moves=given)
    assert some.source == "supplied_moves" and some.per_event.count() == 6
    assert premium.volatility_risk_premium(events, min_events=8).stats.count() == 0
    for q in (-0.1, 0.5):
        with pytest.raises(ValueError):
            premium.volatility_risk_premium(events, trim_quantile=q)


def test_cone(spark):
    bars = ohlcv(np.random.default_rng(11).normal(0, 0.02, 600))
    out = cone.vol_cone(spark.createDataFrame(bars), windows=(5, 20, 900)).orderBy("window").toPandas()
    assert list(out.window) == [5, 20]
    spread = out.q95 - out.q05
    assert spread[1] < spread[0]
    want = (np.log(bars.close).diff().rolling(20).std() * math.sqrt(252)).dropna()
    assert out["q25"][1] == pytest.approx(want.quantile(0.25)) and out["last"][1] == pytest.approx(want.iloc[-1])


def test_no_look_ahead(spark):
    """Changing prices after an entry leaves that entry's inputs alone."""
    bars, dates = sample_history()
    ev = spark.createDataFrame([("SYN", d) for d in dates], "ticker string, announcement_date date")
    changed = bars.copy()
    later = changed.date > dt.date(2024, 7, 9)
    changed.loc[later, ["open", "high", "low", "close"]] *= 1.5

    def inputs(b):
        b = spark.createDataFrame(b)
        rows = backtest.entry_inputs(b, decomposition.decompose_events(b, ev), BacktestConfig())
        return rows.where("entry_date <= '2024-07-09'").select("session_date", "baseline", "calibration", "entry_spot").orderBy("session_date").collect()

    assert inputs(bars) == inputs(changed)


def test_costs_structures_and_bases(sample, events):
    def run(**kw):
        return backtest.run_backtest(sample[0], events, BacktestConfig(**kw)).trades.orderBy("session_date").toPandas()

    free, dear = run(transaction_cost_bps=0), run(transaction_cost_bps=100)
    assert (free.net_pnl > dear.net_pnl).all()
    slipped = run(slippage_vol_points=0.01)
    assert (slipped.execution_adjustment < 0).all() and (free.execution_adjustment.abs() < 1e-12).all()
    rich = run(implied_move_multiplier=1.3)
    assert (rich.front_premium > free.front_premium).all() and (rich.front_pnl > free.front_pnl).all()
    short = run(structure="short_straddle")
    assert (short.back_pnl == 0).all() and short.back_iv.isna().all()
    assert (run(capital_basis="notional").capital_basis == free.entry_spot).all()


def test_supplied_volatilities(spark, sample, events):
    bars = sample[0]
    constant = backtest.run_backtest(bars, events, implied_vols=0.35, implied_vol_days=15)
    assert constant.iv_source == "constant_iv_scenario" and constant.trades.count() == 7
    entry = backtest.entry_inputs(bars, events, BacktestConfig()).select("ticker", "session_date", "entry_date")
    close_ny = F.to_utc_timestamp(F.to_timestamp(F.concat(F.col("entry_date").cast("string"), F.lit(" 16:00:00"))), "America/New_York")
    known = entry.select("ticker", "session_date", F.lit(0.35).alias("implied_vol"), close_ny.alias("observed_at"))
    assert backtest.run_backtest(bars, events, implied_vols=known, strict=True).trades.count() == 7
    late = known.withColumn("observed_at", F.col("observed_at") + F.expr("interval 1 second"))
    assert backtest.run_backtest(bars, events, implied_vols=late, strict=False).trades.count() == 0
    with pytest.raises(BacktestError, match="timestamps"):
        backtest.run_backtest(bars, events, implied_vols=late, strict=True)
    with pytest.raises(BacktestError):
        backtest.run_backtest(bars, events, implied_vols=-0.1)


def test_strict_inputs(spark, sample, events):
    bars = sample[0]
    with pytest.raises(SchemaError):
        backtest.run_backtest(bars.unionByName(bars.limit(1)), events, strict=True)
    with pytest.raises(SchemaError, match="finite"):
        backtest.run_backtest(bars.withColumn("close", F.lit(float("nan"))), events, strict=True)
    with pytest.raises(BacktestError):
        backtest.run_backtest(bars, events.limit(0), strict=True)


@pytest.mark.parametrize(
    "kw",
    [{"structure": "x"}, {"entry_offset": 0}, {"exit_offset": 3}, {"back_expiry_offset": 5}, {"hedge_band": 1}, {"implied_move_multiplier": 0}, {"rate": float("nan")}, {"transaction_cost_bps": -1}, {"capital_basis": "x"}, {"events_per_year": 0}, {"min_history_events": 0}],
)
def test_backtest_settings(kw):
    with pytest.raises(BacktestError):
        BacktestConfig(**kw)


@pytest.mark.parametrize("kw", [{"baseline_windows": (1,)}, {"event_window": 0}, {"post_windows": ()}, {"baseline_gap": -1}, {"announcement_offset": -1}, {"estimator": "x"}, {"periods_per_year": 0}])
def test_decomposition_settings(kw):
    with pytest.raises(ValueError):
        DecompositionConfig(**kw)


def test_event_window_must_meet_the_path():
    with pytest.raises(BacktestError, match="intersect"):
        BacktestConfig(entry_offset=4, exit_offset=0, structure="short_straddle").last_loaded_step(0)


def test_equity_and_charts(spark, result, events):
    rows = [("A", dt.date(2024, 1, d), r) for d, r in ((1, -0.5), (2, 0.2), (3, -0.1))]
    trades = spark.createDataFrame(rows, "ticker string, session_date date, return double")
    flat = backtest.equity_curve(trades).orderBy("session_date").toPandas()
    np.testing.assert_allclose(flat.equity, [0.5, 0.7, 0.6])
    np.testing.assert_allclose(flat.drawdown, [-0.5, -0.3, -0.4])
    grown = backtest.equity_curve(trades, compound=True).orderBy("session_date").toPandas()
    np.testing.assert_allclose(grown.equity, [0.5, 0.6, 0.54])
    chart = report.pnl_chart(backtest.equity_curve(trades)).orderBy("session_date").toPandas()
    np.testing.assert_allclose(chart.drawdown_ratio, [0, 0, 0.6 / 0.7 - 1])
    bins = report.jump_histogram(events).toPandas()
    assert bins.n.sum() == 7 and bins.bin.max() == 20
    line = report.cross_section(decomposition.summarize(events), result.stats).first()
    assert line["events"] == 7 and line["sharpe"] == pytest.approx(0.2579315809)


def test_events_per_year(spark):
    def rate(days):
        rows = [("A", dt.date(2020, 1, 1) + dt.timedelta(days=d)) for d in days]
        return backtest.events_per_year(spark.createDataFrame(rows, "ticker string, session_date date")).first()["events_per_year"]

    assert rate([0, 5]) == 4 and rate([0, 1, 2, 3]) == 12 and rate([0, 800, 1600]) == 1
    assert rate([0, 91, 182]) == pytest.approx(365.25 / 91)


def test_missing_close_in_a_path(spark, sample, events):
    """A path that lacks a close is not traded and does not shift."""
    day = backtest.run_backtest(sample[0], events).trades.agg(F.min("entry_date")).first()[0]
    holed = sample[0].withColumn("close", F.when(F.col("date") == day, F.lit(None)).otherwise(F.col("close")))
    rows = backtest.entry_inputs(holed, events, BacktestConfig())
    assert rows.where("exists(path, c -> c is null) and priceable").count() == 0
    assert rows.where("not priceable").count() > 0 and rows.where("priceable").count() > 0


def test_compounding_ends_at_ruin(spark):
    import datetime as dt

    rows = [("A", dt.date(2024, k, 1), r) for k, r in ((1, 0.1), (2, -1.5), (3, 0.2))]
    curve = backtest.equity_curve(spark.createDataFrame(rows, "ticker string, session_date date, return double"), compound=True).orderBy("session_date").collect()
    assert curve[0]["equity"] == pytest.approx(1.1) and [r["equity"] for r in curve[1:]] == [None, None] == [r["drawdown"] for r in curve[1:]]


def test_texts_for_people(spark, sample, events, result):
    import varsight

    figures = {r["figure"]: r["value"] for r in result.summary_table().collect()}
    assert figures["trades"] == "5" and figures["win rate"] == "60.0%" and figures["Sharpe ratio"] == "0.26"
    told = varsight.volatility_risk_premium(events).to_dict("SYN")
    assert told["implied_source"] == "historical_proxy" and told["n_events"] == 7 and varsight.volatility_risk_premium(events).to_dict("NONE") == {}
    assert {"run_backtest", "decompose_events", "vol_cone", "validate_ohlcv", "REGISTRY"} <= set(varsight.__all__)


def test_statistics_are_one_pass(result):
    plan = result.stats._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 8, plan.count("Exchange hashpartitioning")


def test_problems_are_told_where_nothing_is_raised(spark, sample, events):
    bars = sample[0]
    first = bars.agg(F.min("date")).first()[0]
    assert backtest.run_backtest(bars, events).problems.count() == 0
    bad = bars.withColumn("close", F.when(F.col("date") == first, F.lit(float("nan"))).otherwise(F.col("close")))
    assert [r["problem"] for r in backtest.run_backtest(bad, events, strict=False).problems.collect()] == ["1 closes are not finite and positive"]
    twice = bars.unionByName(bars.where(F.col("date") == first))
    assert [r["problem"] for r in backtest.run_backtest(twice, events, strict=False).problems.collect()] == ["prices need unique session dates"]
    short = bars.orderBy("date").limit(5)
    found = {r["problem"] for r in backtest.input_problems(short, events, backtest.BacktestConfig()).collect()}
    assert found == {"5 sessions; one holding period needs 8", "event positions must be finite, unique and inside the history"}


def test_bad_inputs_raise_by_default(spark, sample, events):
    bars = sample[0]
    with pytest.raises(SchemaError, match="finite"):
        backtest.run_backtest(bars.withColumn("close", F.lit(-1.0)), events)
    with pytest.raises(SchemaError, match="unique session"):
        backtest.run_backtest(bars.unionByName(bars.limit(1)), events)
    with pytest.raises(BacktestError, match="no events"):
        backtest.run_backtest(bars, events.limit(0))
    with pytest.raises(BacktestError, match="history"):
        backtest.run_backtest(bars, events, BacktestConfig(min_history_events=50))


def test_returns_that_cannot_be_compounded_are_told(spark):
    rows = [("A", 1.0, -1.5), ("A", 2.0, 0.1), ("B", 0.0, None), ("C", 1.0, -1.0), ("D", 1.0, 0.3)]
    trades = spark.createDataFrame(rows, "ticker string, capital_basis double, return double")
    told = lambda cfg: {(r["ticker"], r["problem"]) for r in backtest.return_problems(trades, cfg).collect()}
    assert told(BacktestConfig()) == {("B", "1 trades have no positive capital basis")}
    assert told(BacktestConfig(compound=True)) == {("B", "1 trades have no positive capital basis"), ("A", "1 returns at or below -100% cannot be compounded"), ("C", "1 returns at or below -100% cannot be compounded")}
