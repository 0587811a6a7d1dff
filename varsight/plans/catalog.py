"""Registered analytics queries and the SQL each is held against.

Bars come from ``lineitem``: flag and status are the ticker, unit prices its
trades.  Announcements are the first days of its quarters.  Continuous results
are rounded to eight places at this boundary only.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import BacktestConfig, DecompositionConfig
from ..functions import expressions as X
from ..operators import alignment, backtest, cone, decomposition, estimators, long_history, premium, quality, quantiles, report
from ..operators.table_functions import register_table_functions
from ..sources import tables
from ..streaming import bars as stream_bars
from . import oracle

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "decompose_c2c"

C2C = DecompositionConfig()
GAP10 = DecompositionConfig(baseline_gap=10, ddof=1, zero_mean=False)
BT = BacktestConfig()
CONE_WINDOWS = (5, 20, 60)
BLOCKS = long_history.BlockConfig(rows=300, grain=4)
SELECT = quantiles.SelectConfig(grid=50, accuracy=200, few=100, salts=4)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(F.col(f"`{c}`"), 8).alias(c) if t == "double" else F.col(f"`{c}`").cast("long").alias(c) if t == "int" else F.col(f"`{c}`") for c, t in df.dtypes])


class Inputs:
    """The tables a query starts from."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.lineitem = _table(spark, sf_dir, "lineitem")
        self.bars = tables.lineitem_bars(self.lineitem)
        self.announcements = tables.lineitem_announcements(self.lineitem)

    def events(self, cfg: DecompositionConfig = C2C) -> DataFrame:
        return decomposition.decompose_events(self.bars, self.announcements, cfg)

    def trades(self, cfg: BacktestConfig = BT, **more) -> backtest.BacktestResult:
        return backtest.run_backtest(self.bars, self.events(), cfg, C2C, strict=False, **more)

    def damaged(self) -> DataFrame:
        """Bars with rows broken by rule: the thirteenth of a month has its high below its low."""
        return self.bars.withColumn("high", F.when(F.dayofmonth("date") == 13, F.col("low") - 1).otherwise(F.col("high")))

    def holed(self) -> DataFrame:
        """Bars without the second half of every quarter's first month."""
        hole = (F.month("date") % 3 == 1) & (F.dayofmonth("date") > 15)
        return self.bars.where(~hole)


_QUERIES: dict[str, tuple[Callable[[Inputs], DataFrame], str | None]] = {}


def _add(name: str, build: Callable[[Inputs], DataFrame], sql: str | None) -> None:
    _QUERIES[name] = (build, sql)


# bars and their quality
_EXACT = {"daily_bars", "validated_bars", "prices_in_range"}  # plain arithmetic, equal to the last bit
_add("daily_bars", lambda i: i.bars, oracle.daily_bars())
_add(
    "ohlcv_violations",
    lambda i: quality.violations(i.damaged(), allow_zero_volume=False).select("ticker", "n_rows", "n_complete", "n_high_below_low", "first_high_below_low", "n_open_outside", "n_close_outside", "n_duplicated", "n_zero_volume"),
    oracle.base("d AS (SELECT ticker, date, open, low, close, volume, CASE WHEN day(date) = 13 THEN low - 1 ELSE high END AS high FROM bars)")
    + """SELECT ticker, count(*) AS n_rows, count(*) AS n_complete, count(*) FILTER (WHERE high < low) AS n_high_below_low, min(date) FILTER (WHERE high < low) AS first_high_below_low,
  count(*) FILTER (WHERE open < low OR open > high) AS n_open_outside, count(*) FILTER (WHERE close < low OR close > high) AS n_close_outside, 0::BIGINT AS n_duplicated,
  count(*) FILTER (WHERE volume = 0) AS n_zero_volume FROM d GROUP BY ticker""",
)
_add(
    "validated_bars",
    lambda i: tables.load_prices(i.damaged().withColumn("high", F.when(F.col("ticker").startswith("A"), F.col("high")).otherwise(F.greatest("high", "low", "open", "close"))), strict=False, min_rows=60),
    oracle.base("g AS (SELECT ticker, date, open, low, close, volume, CASE WHEN day(date) = 13 THEN greatest(low - 1, low, open, close) ELSE greatest(high, low, open, close) END AS high FROM bars WHERE ticker NOT LIKE 'A%')")
    + "SELECT ticker, date, open, high, low, close, volume FROM g",
)
_add(
    "gap_runs",
    lambda i: quality.detect_gaps(i.holed()),
    "WITH " + oracle._BARS
    + """, h AS (SELECT ticker, date FROM bars WHERE NOT (month(date) % 3 = 1 AND day(date) > 15)),
span AS (SELECT ticker, min(date) AS lo, max(date) AS hi FROM h GROUP BY ticker),
days AS (SELECT ticker, d::DATE AS date FROM span, LATERAL (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS d) WHERE isodow(d) <= 5),
grid AS (SELECT ticker, date, row_number() OVER (PARTITION BY ticker ORDER BY date) AS k FROM days),
miss AS (SELECT g.ticker, g.date, g.k - row_number() OVER (PARTITION BY g.ticker ORDER BY g.date) AS run FROM grid g WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.ticker = g.ticker AND h.date = g.date))
SELECT ticker, min(date) AS gap_start, max(date) AS gap_end, count(*) AS n_days FROM miss GROUP BY ticker, run HAVING count(*) > 4""",
)
_add(
    "hourly_bars",
    lambda i: stream_bars.windowed_bars(stream_bars.event_ticks(_table(i.spark, i.sf_dir, "events"))),
    """SELECT event_type AS ticker, date_trunc('hour', ts) AS bar_start, round(first(value ORDER BY ts, value), 8) AS open, round(max(value), 8) AS high, round(min(value), 8) AS low,
  round(last(value ORDER BY ts, value), 8) AS close, count(*) AS n_ticks FROM events GROUP BY event_type, date_trunc('hour', ts)""",
)



def _broken(bars: DataFrame) -> DataFrame:
    """Bars that break every rule of validation somewhere, by the day of the month."""
    day = F.dayofmonth("date")
    bars = bars.withColumns(
        {
            "open": F.when(day == 3, F.lit(0.0)).otherwise(F.col("open")),
            "high": F.when(day == 13, F.col("low") - 1).otherwise(F.col("high")),
            "low": F.when(day == 5, -F.col("low")).otherwise(F.col("low")),
            "close": F.when(day == 7, -F.col("close")).when(day == 17, F.lit(None)).otherwise(F.col("close")),
            "volume": F.when(day == 9, -F.col("volume")).when(day == 19, F.lit(0.0)).otherwise(F.col("volume")),
        }
    )
    return bars.unionByName(bars.where(F.dayofmonth("date") == 11))


_PRICES = ("open", "high", "low", "close")
_WHOLE = "open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL"
_RULES = {
    "duplicated": "copies > 1",
    **{f"nonpositive_{c}": f"{_WHOLE} AND {c} <= 0" for c in _PRICES},
    "high_below_low": f"{_WHOLE} AND high < low",
    **{f"{c}_outside": f"{_WHOLE} AND ({c} < low OR {c} > high)" for c in ("open", "close")},
    "negative_volume": f"{_WHOLE} AND volume < 0",
    "zero_volume": f"{_WHOLE} AND volume = 0",
}
_BROKEN = """x AS (SELECT ticker, date, CASE WHEN day(date) = 3 THEN 0 ELSE open END AS open, CASE WHEN day(date) = 13 THEN low - 1 ELSE high END AS high,
  CASE WHEN day(date) = 5 THEN -low ELSE low END AS low, CASE WHEN day(date) = 7 THEN -close WHEN day(date) = 17 THEN NULL ELSE close END AS close,
  CASE WHEN day(date) = 9 THEN -volume WHEN day(date) = 19 THEN 0 ELSE volume END AS volume FROM bars),
y AS (SELECT *, count(*) OVER (PARTITION BY ticker, date) AS copies FROM (SELECT * FROM x UNION ALL SELECT * FROM x WHERE day(date) = 11))"""
_add(
    "ohlcv_all_rules",
    lambda i: quality.violations(_broken(i.bars), allow_zero_volume=False),
    oracle.base(_BROKEN)
    + f"SELECT ticker, count(*) AS n_rows, count(*) FILTER (WHERE {_WHOLE}) AS n_complete, count(*) FILTER (WHERE NOT ({_WHOLE})) AS n_incomplete, "
    + ", ".join(f"count(*) FILTER (WHERE {rule}) AS n_{name}, min(date) FILTER (WHERE {rule}) AS first_{name}" for name, rule in _RULES.items())
    + " FROM y GROUP BY ticker",
)
_SPAN = (dt.date(1993, 3, 1), dt.date(1997, 6, 30))
_add(
    "prices_in_range",
    lambda i: tables.load_prices(i.bars.withColumns({"high": F.greatest(*_PRICES), "low": F.least(*_PRICES)}), ["an", " NO"], *_SPAN, min_rows=10, strict=False),
    oracle.base() + f"SELECT ticker, date, open, greatest(open, high, low, close) AS high, least(open, high, low, close) AS low, close, volume FROM bars WHERE ticker IN ('AN', 'NO') AND date BETWEEN '{_SPAN[0]}' AND '{_SPAN[1]}'",
)
_add(
    "gap_descriptions",
    lambda i: quality.describe_gaps(quality.detect_gaps(i.holed())),
    _QUERIES["gap_runs"][1].replace("SELECT ticker, min(date) AS gap_start", ", g AS (SELECT ticker, min(date) AS gap_start")
    + """) SELECT ticker, printf('%d gap(s), the longest of %d weekdays from %s to %s', count(*), max(n_days), arg_max(gap_start, (n_days, gap_start))::VARCHAR, arg_max(gap_end, (n_days, gap_start))::VARCHAR) AS description FROM g GROUP BY ticker""",
)
_STAMPS = "concat(announcement_date, ' 22:30:00-05:00')"
_add(
    "events_from_stamps",
    lambda i: tables.load_events(i.announcements.withColumn("announcement_date", F.expr(_STAMPS)), asof=dt.date(1997, 1, 1), limit=9),
    "WITH " + oracle._BARS + """, a AS (SELECT DISTINCT ticker, date_trunc('quarter', date)::DATE + 1 AS announcement_date FROM li)
SELECT ticker, announcement_date::DATE AS announcement_date FROM a WHERE announcement_date < '1997-01-01' QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY announcement_date DESC) <= 9""",
)

# returns and estimators
_add("log_returns", lambda i: estimators.log_returns(i.bars), oracle.base() + "SELECT ticker, date, pp - 1 AS ret_pos, round(r, 8) AS log_return FROM s WHERE pp >= 1")
_add("realized_variance_zero_mean", lambda i: estimators.realized_variance(i.bars), oracle.base() + "SELECT ticker, round(avg(r * r), 8) AS realized_variance, count(r) AS n_obs FROM s GROUP BY ticker")
_add("realized_variance_demeaned", lambda i: estimators.realized_variance(i.bars, zero_mean=False, ddof=2), oracle.base() + "SELECT ticker, round(var_pop(r) * count(r) / (count(r) - 2), 8) AS realized_variance, count(r) AS n_obs FROM s GROUP BY ticker")
_add("close_to_close_vol", lambda i: estimators.close_to_close(i.bars), oracle.base() + "SELECT ticker, round(stddev_samp(r) * sqrt(252), 8) AS sigma, count(r) AS n_obs FROM s GROUP BY ticker")
_add("parkinson_vol", lambda i: estimators.parkinson(i.bars), oracle.base() + "SELECT ticker, round(sqrt(avg(h2) / (4 * ln(2))) * sqrt(252), 8) AS sigma, count(*) AS n_obs FROM s GROUP BY ticker")
_add(
    "yang_zhang_vol",
    lambda i: estimators.yang_zhang(i.bars),
    oracle.base("q AS (SELECT *, 0.34::DOUBLE / (1.34::DOUBLE + n::DOUBLE / (n - 2)) AS k FROM s WHERE pp >= 1)")
    + "SELECT ticker, round(sqrt(greatest(0, var_samp(o) + any_value(k) * var_samp(c) + (1 - any_value(k)) * avg(u))) * sqrt(252), 8) AS sigma, count(*) + 1 AS n_obs FROM q GROUP BY ticker",
)
_add("rolling_close_to_close", lambda i: estimators.rolling_close_to_close(i.bars, 20), oracle.rolling_sigma("close_to_close", 20))
_add("rolling_parkinson", lambda i: estimators.rolling_parkinson(i.bars, 20), oracle.rolling_sigma("parkinson", 20))
_add("rolling_yang_zhang", lambda i: estimators.rolling_yang_zhang(i.bars, 20), oracle.rolling_sigma("yang_zhang", 20))

# alignment
_STATUS = "SELECT ticker, announcement_date, return_position, session_date, status, CASE WHEN status = 'duplicate' THEN 'same session as an earlier announcement' ELSE why END AS drop_reason FROM status"
_add("aligned_events", lambda i: alignment.aligned_events(i.bars, i.announcements), oracle.base(oracle.status_ctes(C2C)) + "SELECT ticker, announcement_date, p AS return_position, session_date FROM al")
_add("alignment_status", lambda i: alignment.align_events(i.bars, i.announcements), oracle.base(oracle.status_ctes(C2C)) + _STATUS)
_OFFSET1 = DecompositionConfig(announcement_offset=1)
_add("alignment_offset1", lambda i: alignment.align_events(i.bars, i.announcements, _OFFSET1), oracle.base(oracle.status_ctes(_OFFSET1)) + _STATUS)
_add(
    "alignment_counts",
    lambda i: alignment.alignment_counts(alignment.align_events(i.bars, i.announcements)),
    oracle.base(oracle.status_ctes(C2C)) + "SELECT ticker, " + ", ".join(f"count(*) FILTER (WHERE status = '{k}') AS n_{k}" for k in ("aligned", "future", "insufficient", "duplicate")) + " FROM status GROUP BY ticker",
)

_add(
    "alignment_descriptions",
    lambda i: alignment.describe(alignment.align_events(i.bars, i.announcements)),
    oracle.base(oracle.status_ctes(C2C), "k AS (SELECT ticker, " + ", ".join(f"count(*) FILTER (WHERE status = '{k}') AS n_{k}" for k in ("aligned", "future", "insufficient", "duplicate")) + " FROM status GROUP BY ticker)")
    + """SELECT ticker, printf('%d aligned', n_aligned) || CASE WHEN n_future + n_insufficient + n_duplicate > 0 THEN '; dropped: ' || array_to_string(list_filter([CASE WHEN n_duplicate > 0 THEN printf('%d on a session that another has', n_duplicate) END,
  CASE WHEN n_insufficient > 0 THEN printf('%d without enough sessions around', n_insufficient) END, CASE WHEN n_future > 0 THEN printf('%d after the last session', n_future) END], lambda x: x IS NOT NULL), ', ') ELSE '' END AS description FROM k""",
)

# decomposition
for _name, _cfg in {
    "decompose_c2c": C2C,
    "decompose_parkinson": DecompositionConfig(estimator="parkinson"),
    "decompose_yang_zhang": DecompositionConfig(estimator="yang_zhang", baseline_gap=3),
    "decompose_prototype": DecompositionConfig.prototype(),
    "decompose_gap10": GAP10,
}.items():
    _add(_name, lambda i, cfg=_cfg: i.events(cfg), oracle.decompose(_cfg))
_add("decomposition_summary", lambda i: decomposition.summarize(i.events()), oracle.summary(C2C))
_add(
    "decomposition_timeline",
    lambda i: report.decomposition_timeline(i.events()),
    oracle.base(*oracle.event_ctes(C2C)) + f"SELECT {oracle.rounded(['ticker', 'session_date', 'sigma_baseline', 'sigma_jump', 'sigma_total', 'variance_ratio', 'jump_clamped'], oracle.PLAIN)} FROM events_out",
)

_add(
    "event_table",
    lambda i: report.event_table(i.events()),
    oracle.base(*oracle.event_ctes(C2C))
    + "SELECT ticker, row_number() OVER (PARTITION BY ticker ORDER BY session_date) AS place, session_date, "
    + ", ".join(f"round({c}, 4) AS {c}" for c in ("sigma_baseline", "sigma_jump", "sigma_total", "variance_ratio", "event_return"))
    + ", jump_clamped FROM events_out QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY session_date) <= 12",
)

# premium
_add(
    "implied_jump_move",
    lambda i: i.events().select("ticker", "session_date", X.implied_jump_move(F.lit(0.3), F.col("sigma_baseline"), 15).alias("implied_move")),
    oracle.base(*oracle.event_ctes(C2C)) + f"SELECT ticker, session_date, round({oracle.constant_iv(0.3, 15)}, 8) AS implied_move FROM events_out",
)
_add("vrp_proxy", lambda i: premium.volatility_risk_premium(i.events()).per_event, oracle.premium(C2C, oracle.PROXY, "historical_proxy"))
_add("vrp_constant_move", lambda i: premium.volatility_risk_premium(i.events(), implied_moves=0.01).per_event, oracle.premium(C2C, "0.01::DOUBLE", "constant_scenario"))
_add("vrp_constant_iv", lambda i: premium.volatility_risk_premium(i.events(), implied_vols=0.25).per_event, oracle.premium(C2C, oracle.constant_iv(0.25), "constant_iv_scenario"))
_add("vrp_stats_trimmed", lambda i: premium.volatility_risk_premium(i.events(), implied_moves=0.01, trim_quantile=0.1).stats, oracle.premium_stats(C2C, "0.01::DOUBLE", "constant_scenario", 0.1))
_add("vrp_stats_iv", lambda i: premium.volatility_risk_premium(i.events(), implied_vols=0.25).stats, oracle.premium_stats(C2C, oracle.constant_iv(0.25), "constant_iv_scenario", 0.05))
_add(
    "vrp_scatter",
    lambda i: report.premium_scatter(premium.volatility_risk_premium(i.events(), implied_moves=0.01).per_event),
    oracle.base(*oracle.event_ctes(C2C), oracle.premium_cte("0.01::DOUBLE", "constant_scenario"))
    + "SELECT ticker, session_date, round(implied_move, 8) AS implied_move, round(realized_move, 8) AS realized_move, round(max(greatest(implied_move, realized_move)) OVER (PARTITION BY ticker) * 1.1::DOUBLE, 8) AS axis_limit FROM pe",
)

_MOVES = "CASE WHEN month(session_date) <> 7 THEN 0.01D + day(session_date) / 1000D END"
_IVS = "CASE WHEN month(session_date) <> 1 THEN 0.1D + day(session_date) / 100D END"
_SQL_MOVES = "CASE WHEN month(session_date) <> 7 THEN 0.01::DOUBLE + day(session_date) / 1000::DOUBLE END"
_SQL_IVS = "CASE WHEN month(session_date) <> 1 THEN 0.1::DOUBLE + day(session_date) / 100::DOUBLE END"
_GIVEN = "SELECT {} FROM pe WHERE implied_move IS NOT NULL"
_PER_EVENT = oracle.rounded(["ticker", "session_date", "implied_move", "realized_move", "vrp", "vrp_ratio", "implied_source"], ("ticker", "session_date", "implied_source"))
_add(
    "vrp_supplied_moves",
    lambda i: premium.volatility_risk_premium(i.events(), implied_moves=i.events().select("ticker", "session_date", F.expr(_MOVES).alias("implied_move"))).per_event,
    oracle.base(*oracle.event_ctes(C2C), oracle.premium_cte(_SQL_MOVES, "supplied_moves")) + _GIVEN.format(_PER_EVENT),
)
_add(
    "vrp_supplied_iv",
    lambda i: premium.volatility_risk_premium(i.events(), implied_vols=i.events().select("ticker", "session_date", F.expr(_IVS).alias("implied_vol"))).per_event,
    oracle.base(*oracle.event_ctes(C2C), oracle.premium_cte(f"sqrt(greatest(0, (pow({_SQL_IVS}, 2) - sigma_baseline * sigma_baseline) * 21 / 252))", "supplied_iv") + ", pf AS (SELECT * FROM pe WHERE month(session_date) <> 1)")
    + f"SELECT {_PER_EVENT} FROM pf",
)

# cones
for _name, _est in {"cone_c2c": "close_to_close", "cone_parkinson": "parkinson", "cone_yang_zhang": "yang_zhang"}.items():
    _add(_name, lambda i, e=_est: cone.vol_cone(i.bars, CONE_WINDOWS, estimator=e).withColumnRenamed("window", "window_sessions"), oracle.cone(_est, CONE_WINDOWS, cone.QUANTILES))

# options and backtest
_add(
    "straddle_grid",
    lambda i: X.with_straddle(i.bars, "b", F.col("close"), F.col("open"), F.col("high") / F.col("low") - 1 + 0.05, F.dayofmonth("date") / 252.0, 0.01).select("ticker", "date", "b.*"),
    oracle.base() + "SELECT ticker, date, round(price, 8) AS price, round(delta, 8) AS delta, round(gamma, 8) AS gamma FROM ("
    + oracle.straddle("SELECT ticker, date, close AS spot, open AS strike, high / low - 1 + 0.05::DOUBLE AS vol, day(date) / 252::DOUBLE AS tau FROM bars", "ticker, date", 0.01) + ")",
)
_EXPIRING = "greatest(0, day(date) - 15) / 2520D"
_add(
    "straddle_at_expiry",
    lambda i: X.with_straddle(i.bars, "b", F.col("close"), F.col("open") * 1.0123456789, F.lit(0.3), F.expr(_EXPIRING)).select("ticker", "date", "b.*"),
    oracle.base() + "SELECT ticker, date, round(price, 8) AS price, round(delta, 8) AS delta, round(gamma, 8) AS gamma FROM ("
    + oracle.straddle("SELECT ticker, date, close AS spot, open * 1.0123456789::DOUBLE AS strike, 0.3::DOUBLE AS vol, greatest(0, day(date) - 15) / 2520::DOUBLE AS tau FROM bars", "ticker, date") + ")",
)


def _by_sql(i: Inputs) -> DataFrame:
    """The SQL functions, called from SQL text."""
    X.register_sql_functions(i.spark)
    return i.spark.sql(
        "SELECT ticker, date, norm_cdf(close - open) AS cdf, implied_jump_move(0.3D, 0.1D, day(date)) AS move, implied_jump_move(0.3D, 0.1D, day(date), 365D) AS move_365, "
        "straddle_price(close, open, 0.25D, (day(date) - 1) / 252D, 0.02D) AS price, straddle_delta(close, open, 0.25D, (day(date) - 1) / 252D, 0.02D) AS delta FROM {bars}",
        bars=i.bars,
    )


_add(
    "sql_functions",
    _by_sql,
    oracle.base("p AS (" + oracle.straddle("SELECT ticker, date, close AS spot, open AS strike, 0.25::DOUBLE AS vol, (day(date) - 1) / 252::DOUBLE AS tau FROM bars", "ticker, date, spot - strike AS move", 0.02) + ")")
    + f"SELECT ticker, date, round({oracle.cdf('move')}, 8) AS cdf, round(sqrt(0.08::DOUBLE * day(date) / 252), 8) AS move, round(sqrt(0.08::DOUBLE * day(date) / 365), 8) AS move_365, round(price, 8) AS price, round(delta, 8) AS delta FROM p",
)


def _by_table_functions(i: Inputs) -> DataFrame:
    """Alignment and decomposition, called from SQL text."""
    register_table_functions(i.spark, i.bars, i.announcements, C2C)
    return i.spark.sql(
        """SELECT e.ticker, e.session_date, a.announcement_date, a.status, e.sigma_jump, e.variance_ratio, n.n_future
FROM decomposed_events(NULL, DATE'1996-01-01', DATE'1999-12-31') e JOIN aligned_events() a ON a.ticker = e.ticker AND a.session_date = e.session_date
JOIN (SELECT ticker, count_if(status = 'future') AS n_future FROM aligned_events() GROUP BY ticker) n ON n.ticker = e.ticker
WHERE e.ticker <> 'RO' UNION ALL SELECT ticker, session_date, announcement_date, 'one ticker', sigma_jump, variance_ratio, 0L FROM decomposed_events('RO')"""
    )


_add(
    "sql_table_functions",
    _by_table_functions,
    oracle.base(*oracle.event_ctes(C2C))
    + """SELECT e.ticker, e.session_date, a.announcement_date, a.status, round(sigma_jump, 8) AS sigma_jump, round(variance_ratio, 8) AS variance_ratio, n_future FROM events_out e
JOIN status a ON a.ticker = e.ticker AND a.session_date = e.session_date JOIN (SELECT ticker, count(*) FILTER (WHERE status = 'future') AS n_future FROM status GROUP BY ticker) n ON n.ticker = e.ticker
WHERE e.ticker <> 'RO' AND e.session_date BETWEEN '1996-01-01' AND '1999-12-31'
UNION ALL SELECT ticker, session_date, announcement_date, 'one ticker', round(sigma_jump, 8), round(variance_ratio, 8), 0 FROM events_out WHERE ticker = 'RO'""",
)
_add(
    "entry_inputs",
    lambda i: backtest.entry_inputs(i.bars, i.events(), BT, C2C).select("ticker", "session_date", "entry_date", "exit_date", "baseline", "history_events", "calibration", "usable"),
    oracle.entry_inputs(BT, C2C),
)
for _est in ("parkinson", "yang_zhang"):
    _ev = DecompositionConfig(estimator=_est)
    _add(
        f"entry_inputs_{_est}",
        lambda i, ev=_ev: backtest.entry_inputs(i.bars, i.events(ev), BT, ev).select("ticker", "session_date", "entry_date", "exit_date", "baseline", "history_events", "calibration", "usable"),
        oracle.entry_inputs(BT, _ev),
    )


def _observed(i: Inputs) -> DataFrame:
    """A volatility by event, observed at 20:00 UTC of the entry day, or where the event's day is even a day later."""
    rows = backtest.entry_inputs(i.bars, i.events(), BT, C2C)
    hours = F.when(F.dayofmonth("session_date") % 2 == 0, 44).otherwise(20)
    seen = F.col("entry_date").cast("timestamp") + F.make_dt_interval(hours=hours)
    return rows.where(F.month("session_date") != 4).select("ticker", "session_date", (0.2 + F.dayofmonth("session_date") / 100.0).alias("implied_vol"), seen.alias("observed_at"))


_TIMED = "month(session_date) <> 4 AND (entry_date + INTERVAL (CASE WHEN day(session_date) % 2 = 0 THEN 44 ELSE 20 END) HOUR) <= timezone('UTC', (entry_date + INTERVAL 16 HOUR) AT TIME ZONE 'America/New_York')"
_add(
    "trades_timestamped_iv",
    lambda i: i.trades(implied_vols=_observed(i), implied_vol_days=15).trades,
    oracle.trades(BT, C2C, backtest.TRADE_COLUMNS, iv="(0.2::DOUBLE + day(session_date) / 100::DOUBLE)", iv_days=15, known=_TIMED),
)
for _name, _bt, _iv in [
    ("trades_calendar", BT, {}),
    ("trades_short_straddle", BacktestConfig(structure="short_straddle", exit_offset=2, rate=0.02), {}),
    ("trades_constant_iv", BT, {"iv": 0.3, "iv_days": 15}),
    ("trades_net_credit", BacktestConfig(capital_basis="net_credit", implied_move_multiplier=1.1), {}),
    ("trades_slippage", BacktestConfig(slippage_vol_points=0.01, back_iv_multiplier=1.2, capital_basis="notional"), {}),
]:
    _more = {"implied_vols": _iv["iv"], "implied_vol_days": _iv["iv_days"]} if _iv else {}
    _add(_name, lambda i, c=_bt, m=_more: i.trades(c, **m).trades, oracle.trades(_bt, C2C, backtest.TRADE_COLUMNS, **_iv))
_add(
    "equity_drawdown",
    lambda i: i.trades().equity.select("ticker", "session_date", "return", "equity", "peak", "drawdown"),
    oracle.base(*oracle.trade_ctes(BT, C2C), oracle.EQUITY) + 'SELECT ticker, session_date, round("return", 8) AS "return", round(equity, 8) AS equity, round(peak, 8) AS peak, round(equity - peak, 8) AS drawdown FROM eq2',
)
COMPOUND = BacktestConfig(compound=True, capital_basis="notional")
_add(
    "equity_compounded",
    lambda i: i.trades(COMPOUND).equity,
    oracle.base(*oracle.trade_ctes(COMPOUND, C2C), oracle.compounded()) + 'SELECT ticker, session_date, round("return", 8) AS "return", round(equity, 8) AS equity, round(peak, 8) AS peak, round(equity / peak - 1, 8) AS drawdown FROM eq2',
)
_add(
    "trade_stats_compounded",
    lambda i: i.trades(COMPOUND).stats.select(*oracle.STATS),
    oracle.base(*oracle.trade_ctes(COMPOUND, C2C), *oracle.stats_ctes(compound=True)) + f"SELECT {oracle.rounded(oracle.STATS, ('ticker',))} FROM stats",
)
_add(
    "summary_table",
    lambda i: i.trades().summary_table(),
    oracle.base(*oracle.trade_ctes(BT, C2C), *oracle.stats_ctes())
    + " UNION ALL ".join(
        f"SELECT ticker, {k}::BIGINT AS place, '{label}' AS figure, CASE WHEN {name} IS NULL THEN 'n/a' WHEN isinf({name}) THEN CASE WHEN {name} > 0 THEN 'inf' ELSE '-inf' END ELSE printf('{style}', {name}{' * 100' if '%%' in style else ''}) END AS value FROM stats"
        for k, (name, (label, style)) in enumerate(backtest._SHOWN.items())
    ),
)
_add("trade_stats", lambda i: i.trades().stats.select(*oracle.STATS), oracle.base(*oracle.trade_ctes(BT, C2C), *oracle.stats_ctes()) + f"SELECT {oracle.rounded(oracle.STATS, ('ticker',))} FROM stats")
_add(
    "skipped_events",
    lambda i: i.trades().skipped,
    oracle.base(*oracle.entry_ctes(BT, C2C)) + "SELECT ticker, count(*) FILTER (WHERE NOT (priceable AND calibration IS NOT NULL)) AS n_skipped, count(*) FILTER (WHERE priceable AND calibration IS NOT NULL) AS n_traded FROM ei GROUP BY ticker",
)
_add(
    "backtest_problems",
    lambda i: backtest.input_problems(
        i.bars.withColumn("close", F.when(F.col("ticker").startswith("A") & (F.dayofmonth("date") == 13), -F.col("close")).otherwise(F.col("close"))).unionByName(i.bars.where("ticker like 'N%' and day(date) = 11")).where("ticker <> 'RF' or year(date) < 1996"),
        i.events(), BT,
    ),
    oracle.base(*oracle.event_ctes(C2C))
    + """, d AS (SELECT ticker, date, CASE WHEN ticker LIKE 'A%' AND day(date) = 13 THEN -close ELSE close END AS close FROM bars WHERE ticker <> 'RF' OR year(date) < 1996 UNION ALL SELECT ticker, date, close FROM bars WHERE ticker LIKE 'N%' AND day(date) = 11),
k AS (SELECT ticker, count(*) - count(DISTINCT date) AS repeats, count(*) FILTER (WHERE close <= 0) AS bad, count(*) AS n FROM d GROUP BY ticker), l AS (SELECT ticker, max(return_position) AS last FROM events_out GROUP BY ticker)
SELECT ticker, 'prices need unique session dates' AS problem FROM k WHERE repeats > 0 UNION ALL SELECT ticker, printf('%d closes are not finite and positive', bad) FROM k WHERE bad > 0
UNION ALL SELECT ticker, 'event positions must be finite, unique and inside the history' FROM k JOIN l USING (ticker) WHERE last + 1 >= n""",
)
_add("events_per_year", lambda i: backtest.events_per_year(i.events()), oracle.base(*oracle.event_ctes(C2C), oracle.RATES.format(table="events_out")) + "SELECT ticker, round(events_per_year, 8) AS events_per_year FROM rates")

# long windows, and histories in blocks: each equals its plain form
for _est in ("close_to_close", "parkinson", "yang_zhang"):
    _add(f"rolling_{_est}_long_window", lambda i, e=_est: estimators.REGISTRY[e][1](i.bars, 480), oracle.rolling_sigma(_est, 480))
    _add(
        f"blocks_rolling_{_est}",
        lambda i, e=_est: long_history.rolling_volatility(i.bars, e, 200, cfg=BLOCKS).select("ticker", "date", "sigma"),
        oracle.rolling_sigma(_est, 200),
    )
_LONG = DecompositionConfig(baseline_windows=(150, 20), post_windows=(5,), baseline_gap=5, announcement_offset=1)
_add("blocks_log_returns", lambda i: long_history.log_returns(i.bars, BLOCKS), _QUERIES["log_returns"][1])
_add("blocks_alignment_status", lambda i: long_history.align_events(i.bars, i.announcements, C2C, BLOCKS), _QUERIES["alignment_status"][1])
_add("blocks_alignment_offset1", lambda i: long_history.align_events(i.bars, i.announcements, _OFFSET1, BLOCKS), _QUERIES["alignment_offset1"][1])
_add("blocks_decompose_c2c", lambda i: long_history.decompose_events(i.bars, i.announcements, C2C, BLOCKS), oracle.decompose(C2C))
_add("blocks_decompose_yang_zhang", lambda i: long_history.decompose_events(i.bars, i.announcements, DecompositionConfig(estimator="yang_zhang", baseline_gap=3), BLOCKS), _QUERIES["decompose_yang_zhang"][1])
_add("decompose_long_windows", lambda i: i.events(_LONG), oracle.decompose(_LONG))
_add("blocks_decompose_long_windows", lambda i: long_history.decompose_events(i.bars, i.announcements, _LONG, BLOCKS), oracle.decompose(_LONG))
_add("blocks_cone_c2c", lambda i: long_history.vol_cone(i.bars, CONE_WINDOWS, blocks=BLOCKS, select=SELECT).withColumnRenamed("window", "window_sessions"), _QUERIES["cone_c2c"][1])
_FEW = long_history.BlockConfig(rows=4, grain=2)
_add("blocks_equity_drawdown", lambda i: long_history.equity_curve(i.trades().trades, cfg=_FEW), _QUERIES["equity_drawdown"][1])
_add("blocks_equity_compounded", lambda i: long_history.equity_curve(i.trades(COMPOUND).trades, True, _FEW), _QUERIES["equity_compounded"][1])
_add(
    "price_quantiles",
    lambda i: quantiles.exact_quantiles(i.lineitem, ["l_returnflag"], "l_extendedprice", (0.01, 0.25, 0.5, 0.9), SELECT).select("l_returnflag", "n", *[F.col("quantiles")[k].alias(f"q{k}") for k in range(4)]),
    "SELECT l_returnflag, count(*) AS n, " + ", ".join(f"round(quantile_cont(l_extendedprice::DOUBLE, {q}), 8) AS q{k}" for k, q in enumerate((0.01, 0.25, 0.5, 0.9))) + " FROM lineitem WHERE l_extendedprice IS NOT NULL GROUP BY l_returnflag",
)

# reports
_CROSS = {"mean_sigma_baseline": "baseline", "mean_sigma_jump": "jump", "mean_sigma_total": "total", "mean_variance_ratio": "var_ratio", "mean_abs_event_return": "mean_move", "downside_share": "downside_share", "clamp_rate": "clamp_rate", "win_rate": "win_rate", "sharpe_ratio": "sharpe"}
_add(
    "cross_section",
    lambda i: report.universe_cross_section(i.bars, tables.quarter_starts(i.bars), C2C, BT),
    oracle.base(*oracle.trade_ctes(BT, C2C), *oracle.stats_ctes(), f"sm_ AS ({oracle.summary_select(C2C)})")
    + "SELECT ticker, n_events AS events, " + ", ".join(f"round({a}, 8) AS {b}" for a, b in _CROSS.items()) + " FROM sm_ LEFT JOIN stats USING (ticker)",
)
_add(
    "stage_status",
    lambda i: report.stage_status(
        i.bars, decomposition.summarize(i.events()), premium.volatility_risk_premium(i.events(), min_events=27).stats, i.trades(BacktestConfig(min_history_events=26)).stats
    ).select("ticker", F.to_json("stages").alias("stages")),
    oracle.base(*oracle.trade_ctes(BacktestConfig(min_history_events=26), C2C), "ec_ AS (SELECT ticker, count(*) AS n FROM events_out GROUP BY ticker)", "tc_ AS (SELECT DISTINCT ticker FROM trades)")
    + """SELECT b.ticker, printf('{"decomposition":"%s","vrp":"%s","backtest":"%s"}', CASE WHEN e.n > 0 THEN 'ok' ELSE 'failed' END, CASE WHEN e.n >= 27 THEN 'ok' ELSE 'skipped' END, CASE WHEN t.ticker IS NULL THEN 'failed' ELSE 'ok' END) AS stages
FROM (SELECT DISTINCT ticker FROM bars) b LEFT JOIN ec_ e ON e.ticker = b.ticker LEFT JOIN tc_ t ON t.ticker = b.ticker""",
)
_add(
    "jump_histogram",
    lambda i: report.jump_histogram(i.events()),
    oracle.base(*oracle.event_ctes(C2C))
    + """, b AS (SELECT ticker, min(sigma_jump) AS lo, max(sigma_jump) AS hi FROM events_out GROUP BY ticker),
k AS (SELECT e.ticker, least(20, floor((sigma_jump - lo) / ((hi - lo) / 20))::BIGINT + 1) AS bin, lo, hi FROM events_out e JOIN b USING (ticker))
SELECT ticker, bin, round(lo + (hi - lo) / 20 * (bin - 1), 8) AS bin_lo, round(lo + (hi - lo) / 20 * bin, 8) AS bin_hi, count(*) AS n FROM k GROUP BY ticker, bin, lo, hi""",
)
_add(
    "jump_summary",
    lambda i: report.jump_summary(i.events()),
    oracle.base(*oracle.event_ctes(C2C)) + "SELECT ticker, round(avg(sigma_jump), 8) AS mean_jump, round(median(sigma_jump), 8) AS median_jump, count(*) FILTER (WHERE sigma_jump = 0) AS n_zero, round(avg(sigma_baseline), 8) AS mean_baseline FROM events_out GROUP BY ticker",
)
_add(
    "pnl_chart_data",
    lambda i: report.pnl_chart(i.trades().equity),
    oracle.base(*oracle.trade_ctes(BT, C2C), oracle.EQUITY)
    + 'SELECT ticker, session_date, round("return", 8) AS "return", round(equity, 8) AS equity, round(running_peak, 8) AS running_peak, round(CASE WHEN running_peak != 0 THEN equity / running_peak - 1 END, 8) AS drawdown_ratio FROM eq2',
)


def _run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _QUERIES[name][0](Inputs(spark, sf_dir))
    return df if name in _EXACT else _rounded(df)


def queries() -> dict[str, Query]:
    return {name: partial(_run, name) for name in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql is not None}
