"""DuckDB SQL that recomputes the analytics queries in another shape.

Frames become joins on session positions, the as-of step an ASOF JOIN, the
calibration a self join: an independent check, not a transcript of the plans.
"""

from __future__ import annotations

from ..config import BacktestConfig, DecompositionConfig
from ..functions.expressions import CDF_DENOMINATOR, CDF_NUMERATOR, CDF_ROOT_2_PI, CDF_SPLIT

PI = "3.141592653589793"
MOVE = "0.7978845608028654"  # square root of 2 / pi

_BARS = """li AS (
  SELECT l_returnflag || l_linestatus AS ticker, l_shipdate::DATE AS date, 100::DOUBLE + l_extendedprice / l_quantity / 1000 AS price,
         l_quantity::DOUBLE AS size, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem),
bars AS (
  SELECT ticker, date, first(price ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, price) AS open, max(price) AS high, min(price) AS low,
         last(price ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, price) AS close, sum(size) AS volume FROM li GROUP BY ticker, date)"""

_SESSIONS = """, s AS (
  SELECT ticker, date, open, high, low, close, row_number() OVER w - 1 AS pp, count(*) OVER (PARTITION BY ticker) AS n,
         ln(close) - lag(ln(close)) OVER w AS r, ln(open) - lag(ln(close)) OVER w AS o,
         ln(close / open) AS c, ln(high / open) * (ln(high / open) - ln(close / open)) + ln(low / open) * (ln(low / open) - ln(close / open)) AS u,
         ln(high / low) * ln(high / low) AS h2
  FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date))"""


def rounded(columns: list[str], plain: tuple[str, ...] = (), prefix: str = "") -> str:
    """A select list: plain columns as they are, the others rounded to 8 places."""
    return ", ".join(f"{prefix}{c} AS {c}" if c in plain else f'round({prefix}"{c}", 8) AS "{c}"' for c in columns)


def base(*more: str) -> str:
    return "WITH " + _BARS + _SESSIONS + "".join(", " + m for m in more) + "\n"


def daily_bars() -> str:
    return "WITH " + _BARS + " SELECT ticker, date, open, high, low, close, volume FROM bars"


def rolling(estimator: str, window: int, kind: str = "demeaned") -> str:
    """CTE text ``roll``: per-session variance by (ticker, pp), from a self join."""
    if estimator == "close_to_close":
        value = "avg(x.r * x.r)" if kind == "zero" else "var_samp(x.r)"
        need, least = "count(x.r)", window
    elif estimator == "parkinson":
        value, need, least = "avg(x.h2) / (4 * ln(2))", "count(x.h2)", window
    else:
        k = f"(0.34::DOUBLE / (1.34::DOUBLE + {window + 1}::DOUBLE / {window - 1}))"
        value = f"greatest(0, var_samp(x.o) + {k} * var_samp(x.c) + (1 - {k}) * avg(x.u))"
        need, least = "count(x.o)", window
    return f"""roll_{window} AS (SELECT y.ticker, y.pp, y.date, y.n, {value} AS v FROM s y JOIN s x
  ON x.ticker = y.ticker AND x.pp BETWEEN y.pp - {window - 1} AND y.pp GROUP BY y.ticker, y.pp, y.date, y.n HAVING {need} = {least})"""


def rolling_sigma(estimator: str, window: int) -> str:
    return base(rolling(estimator, window)) + f"SELECT s.ticker, s.date, round(sqrt(v) * sqrt(252), 8) AS sigma FROM s LEFT JOIN roll_{window} q USING (ticker, pp)"


def status_ctes(cfg: DecompositionConfig) -> str:
    return f"""ann AS (SELECT DISTINCT ticker, date_trunc('quarter', date)::DATE AS announcement_date FROM li),
rets AS (SELECT ticker, date, pp - 1 AS rp, n - 1 AS nr FROM s WHERE pp >= 1),
placed AS (SELECT a.ticker, a.announcement_date, coalesce(x.rp, m.nr) + {cfg.announcement_offset} AS p, m.nr
  FROM (SELECT * FROM ann) a JOIN (SELECT DISTINCT ticker, nr FROM rets) m ON m.ticker = a.ticker
  ASOF LEFT JOIN rets x ON a.ticker = x.ticker AND a.announcement_date <= x.date),
judged AS (SELECT *, CASE WHEN p >= nr THEN 'future' WHEN p < {cfg.back_need} OR p + {cfg.forward_need} > nr THEN 'insufficient' END AS early,
  CASE WHEN p >= nr THEN 'after the last session' WHEN p < {cfg.back_need} THEN 'needs {cfg.back_need} sessions before the event'
       WHEN p + {cfg.forward_need} > nr THEN 'needs {cfg.forward_need} sessions from the event' END AS why FROM placed),
status AS (SELECT j.ticker, j.announcement_date, j.p AS return_position, d.date AS session_date,
  CASE WHEN early IS NOT NULL THEN early WHEN EXISTS (SELECT 1 FROM judged k WHERE k.ticker = j.ticker AND k.p = j.p AND k.early IS NULL
       AND k.announcement_date < j.announcement_date) THEN 'duplicate' ELSE 'aligned' END AS status, why
  FROM judged j LEFT JOIN rets d ON d.ticker = j.ticker AND d.rp = j.p),
al AS (SELECT ticker, announcement_date, return_position AS p, session_date FROM status WHERE status = 'aligned')"""


def _var(cfg: DecompositionConfig) -> str:
    if cfg.zero_mean:
        return "avg(x.r * x.r)"
    return {0: "var_pop(x.r)", 1: "var_samp(x.r)"}[cfg.ddof]


def _gather(name: str, value: str, lo: str, hi: str) -> str:
    """Aggregate of the returns between two positions around each event."""
    return f"""{name} AS (SELECT e.ticker, e.p, {value} AS v FROM al e JOIN s x ON x.ticker = e.ticker AND x.pp - 1 BETWEEN e.p + ({lo}) AND e.p + ({hi}) GROUP BY e.ticker, e.p)"""


def event_columns(cfg: DecompositionConfig) -> list[str]:
    return [
        "ticker", "session_date", "announcement_date", "return_position", "close", "sigma_total",
        *[f"sigma_baseline_{w}" for w in cfg.baseline_windows], "sigma_baseline", "sigma_jump", "var_jump_raw", "jump_clamped", "variance_ratio",
        *[f"sigma_post_{k}" for k in cfg.post_windows], "event_return", "abs_event_return", "event_window_log_return",
    ]


PLAIN = ("ticker", "session_date", "announcement_date", "return_position", "jump_clamped")


def event_ctes(cfg: DecompositionConfig) -> list[str]:
    """CTEs up to ``events``, with unrounded columns."""
    ctes, s = [status_ctes(cfg)], f"{cfg.scale!r}::DOUBLE"
    last = cfg.event_window - 1
    ctes.append(_gather("tot", _var(cfg), "0", str(last)))
    ctes.append(_gather("mv", "arg_max(x.r, abs(x.r) - x.pp * 1e-18)", "0", str(last)))
    ctes.append(_gather("sm", "sum(x.r)", "0", str(last)))
    for w in cfg.baseline_windows:
        if cfg.estimator == "close_to_close":
            ctes.append(_gather(f"b{w}", _var(cfg), f"-{cfg.baseline_gap + w}", f"-{cfg.baseline_gap + 1}"))
        else:
            ctes.append(rolling(cfg.estimator, w))
            ctes.append(f"b{w} AS (SELECT e.ticker, e.p, q.v FROM al e JOIN roll_{w} q ON q.ticker = e.ticker AND q.pp = e.p - {cfg.baseline_gap})")
    ctes += [_gather(f"f{k}", _var(cfg), "1", str(k)) for k in cfg.post_windows]
    parts = ["tot", "mv", "sm", *[f"b{w}" for w in cfg.baseline_windows], *[f"f{k}" for k in cfg.post_windows]]
    joins = " ".join(f"JOIN {t} USING (ticker, p)" for t in parts)
    b = f"b{cfg.primary_baseline}.v"
    columns = ["al.ticker", "al.session_date", "al.announcement_date", "al.p AS return_position", "z.close", f"sqrt(tot.v) * {s} AS sigma_total"]
    columns += [f"sqrt(b{w}.v) * {s} AS sigma_baseline_{w}" for w in cfg.baseline_windows]
    columns += [
        f"sqrt({b}) * {s} AS sigma_baseline", f"sqrt(greatest(tot.v - {b}, 0)) * {s} AS sigma_jump", f"tot.v - {b} AS var_jump_raw", f"tot.v - {b} < 0 AS jump_clamped",
        f"CASE WHEN {b} > 0 THEN tot.v / {b} END AS variance_ratio", *[f"sqrt(f{k}.v) * {s} AS sigma_post_{k}" for k in cfg.post_windows],
        "mv.v AS event_return", "abs(mv.v) AS abs_event_return", "sm.v AS event_window_log_return",
    ]
    ctes.append(f"events_out AS (SELECT {', '.join(columns)} FROM al {joins} JOIN s z ON z.ticker = al.ticker AND z.pp = al.p + 1)")
    return ctes


def decompose(cfg: DecompositionConfig) -> str:
    return base(*event_ctes(cfg)) + f"SELECT {rounded(event_columns(cfg), PLAIN)} FROM events_out"


def summary_select(cfg: DecompositionConfig) -> str:
    posts = "".join(f", avg(sigma_post_{k}) AS mean_sigma_post_{k}" for k in cfg.post_windows)
    return f"""SELECT ticker, count(*) AS n_events, avg(sigma_jump) AS mean_sigma_jump, median(sigma_jump) AS median_sigma_jump, avg(sigma_baseline) AS mean_sigma_baseline,
  avg(sigma_total) AS mean_sigma_total, avg(abs_event_return) AS mean_abs_event_return, median(abs_event_return) AS median_abs_event_return,
  avg(variance_ratio) AS mean_variance_ratio, avg(jump_clamped::INT::DOUBLE) AS clamp_rate, avg((event_return < 0)::INT::DOUBLE) AS downside_share{posts} FROM events_out GROUP BY ticker"""


SUMMARY = ["ticker", "n_events", "mean_sigma_jump", "median_sigma_jump", "mean_sigma_baseline", "mean_sigma_total", "mean_abs_event_return", "median_abs_event_return", "mean_variance_ratio", "clamp_rate", "downside_share"]


def summary(cfg: DecompositionConfig) -> str:
    columns = [*SUMMARY, *[f"mean_sigma_post_{k}" for k in cfg.post_windows]]
    return base(*event_ctes(cfg)) + f"SELECT {rounded(columns, ('ticker', 'n_events'))} FROM ({summary_select(cfg)})"


def premium_cte(implied: str, source: str) -> str:
    return f"""pe AS (SELECT ticker, session_date, implied_move, realized_move, implied_move - realized_move AS vrp,
  CASE WHEN realized_move > 0 THEN implied_move / realized_move END AS vrp_ratio, '{source}' AS implied_source
  FROM (SELECT ticker, session_date, abs_event_return AS realized_move, {implied} AS implied_move, count(*) OVER (PARTITION BY ticker) AS m FROM events_out) WHERE m >= 4)"""


PROXY = "(sum(abs_event_return) OVER (PARTITION BY ticker) - abs_event_return) / (count(*) OVER (PARTITION BY ticker) - 1)"


def constant_iv(iv: float, days: int = 21) -> str:
    return f"sqrt(greatest(0, ({iv}::DOUBLE * {iv} - sigma_baseline * sigma_baseline) * {days} / 252))"


def premium(cfg: DecompositionConfig, implied: str, source: str) -> str:
    columns = ["ticker", "session_date", "implied_move", "realized_move", "vrp", "vrp_ratio", "implied_source"]
    return base(*event_ctes(cfg), premium_cte(implied, source)) + f"SELECT {rounded(columns, ('ticker', 'session_date', 'implied_source'))} FROM pe"


def premium_stats(cfg: DecompositionConfig, implied: str, source: str, q: float) -> str:
    return (
        base(*event_ctes(cfg), premium_cte(implied, source), f"cut AS (SELECT ticker, quantile_cont(vrp, {q}) AS lo, quantile_cont(vrp, {1 - q}) AS hi, count(*) AS m FROM pe GROUP BY ticker)")
        + """SELECT ticker, round(avg(vrp), 8) AS mean_vrp, round(median(vrp), 8) AS median_vrp, round(avg(vrp) FILTER (WHERE m < 5 OR vrp BETWEEN lo AND hi), 8) AS mean_vrp_ex_outliers,
  round(avg((implied_move > realized_move)::INT::DOUBLE), 8) AS hit_rate, round(avg(vrp) / (stddev_samp(vrp) / sqrt(count(*))), 8) AS t_stat, count(*) AS n_events,
  count(*) FILTER (WHERE NOT (m < 5 OR vrp BETWEEN lo AND hi)) AS n_trimmed FROM pe JOIN cut USING (ticker) GROUP BY ticker"""
    )


def cone(estimator: str, windows, quantiles) -> str:
    ctes = [rolling(estimator, w) for w in windows]
    union = " UNION ALL ".join(f"SELECT ticker, {w} AS win, pp, n, sqrt(v) * sqrt(252) AS sigma FROM roll_{w}" for w in windows)
    named = ", ".join(f"round(quantile_cont(sigma, {q}), 8) AS q{round(q * 100):02d}" for q in quantiles)
    return base(*ctes, f"a AS ({union})") + f"SELECT ticker, win::BIGINT AS window_sessions, {named}, round(arg_max(sigma, pp), 8) AS last, count(*) AS n_obs FROM a WHERE win + 2 <= n GROUP BY ticker, win"


def cdf(x: str) -> str:
    def horner(coefficients: tuple[float, ...]) -> str:
        text = f"{coefficients[0]!r}::DOUBLE"
        for c in coefficients[1:]:
            text = f"({text} * abs({x}) + {c!r}::DOUBLE)"
        return text

    e = f"exp(-({x}) * ({x}) / 2)"
    far = f"{e} / (abs({x}) + 1 / (abs({x}) + 2 / (abs({x}) + 3 / (abs({x}) + 4 / (abs({x}) + 0.65::DOUBLE))))) / {CDF_ROOT_2_PI}::DOUBLE"
    tail = f"(CASE WHEN abs({x}) > 37 THEN 0 WHEN abs({x}) < {CDF_SPLIT}::DOUBLE THEN {e} * {horner(CDF_NUMERATOR)} / {horner(CDF_DENOMINATOR)} ELSE {far} END)"
    return f"(CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END)"


def straddle(source: str, keep: str, rate: float = 0.0) -> str:
    """Price and delta for rows of ``source`` with spot, strike, vol and tau, as two nested selects."""
    t = "greatest(tau, 0.5::DOUBLE / 252)"
    d = f"SELECT *, {t} AS t_, (ln(spot / strike) + ({rate}::DOUBLE + vol * vol / 2) * {t}) / (vol * sqrt({t})) AS d1 FROM ({source})"
    n = f"SELECT *, {cdf('d1')} AS n1, {cdf('(d1 - vol * sqrt(t_))')} AS n2 FROM ({d})"
    return f"""SELECT {keep}, CASE WHEN tau > 0 THEN spot * (2 * n1 - 1) - strike * exp(-({rate}::DOUBLE) * t_) * (2 * n2 - 1) ELSE abs(spot - strike) END AS price,
  CASE WHEN tau > 0 THEN 2 * n1 - 1 ELSE sign(spot - strike)::DOUBLE END AS delta,
  CASE WHEN tau > 0 THEN 2 * exp(-d1 * d1 / 2) / sqrt(2 * {PI}) / (spot * vol * sqrt(t_)) ELSE 0 END AS gamma FROM ({n})"""


def entry_ctes(cfg: BacktestConfig, ev: DecompositionConfig) -> list[str]:
    e, x, w = cfg.entry_offset, cfg.exit_offset, ev.primary_baseline
    baseline = f"""eb AS (SELECT e0.ticker, e0.pp, CASE WHEN count(y.r) = {w} THEN sqrt({_var(ev).replace("x.", "y.")} * {cfg.periods_per_year}) END AS baseline
  FROM e0 LEFT JOIN s y ON y.ticker = e0.ticker AND y.pp BETWEEN e0.pp - {e + w - 1} AND e0.pp - {e} GROUP BY e0.ticker, e0.pp)"""
    if ev.estimator != "close_to_close":
        baseline = f"eb AS (SELECT e0.ticker, e0.pp, sqrt(q.v * {cfg.periods_per_year}) AS baseline FROM e0 LEFT JOIN roll_{w} q ON q.ticker = e0.ticker AND q.pp = e0.pp - {e})"
    return [
        *event_ctes(ev),
        "e0 AS (SELECT ticker, session_date, announcement_date, return_position + 1 AS pp, abs_event_return AS move FROM events_out)",
        baseline,
        f"""ec AS (SELECT a.ticker, a.pp, count(b.move) AS history_events, avg(b.move) AS mean_move FROM e0 a LEFT JOIN e0 b
  ON b.ticker = a.ticker AND b.pp < a.pp AND b.pp + {ev.event_window} - 1 <= a.pp - {e} GROUP BY a.ticker, a.pp)""",
        f"""ei AS (SELECT e0.ticker, e0.session_date, e0.announcement_date, e0.pp, e0.move, baseline, history_events,
  CASE WHEN history_events >= {cfg.min_history_events} THEN mean_move * {cfg.implied_move_multiplier}::DOUBLE END AS calibration,
  i.date AS entry_date, v.date AS event_date, o.date AS exit_date, i.close AS entry_spot, o.close AS exit_spot,
  e0.pp - {cfg.back_need} >= 0 AND e0.pp + {cfg.forward_need} < v.n AND coalesce(baseline > 0, false) AS priceable
  FROM e0 JOIN eb USING (ticker, pp) JOIN ec USING (ticker, pp) JOIN s v ON v.ticker = e0.ticker AND v.pp = e0.pp
  LEFT JOIN s i ON i.ticker = e0.ticker AND i.pp = e0.pp - {e} LEFT JOIN s o ON o.ticker = e0.ticker AND o.pp = e0.pp + {x})""",
    ]


def entry_inputs(cfg: BacktestConfig, ev: DecompositionConfig) -> str:
    columns = ["ticker", "session_date", "entry_date", "exit_date", "baseline", "history_events", "calibration", "usable"]
    plain = ("ticker", "session_date", "entry_date", "exit_date", "history_events", "usable")
    return base(*entry_ctes(cfg, ev)) + f"SELECT {rounded(columns, plain)} FROM (SELECT *, priceable AND calibration IS NOT NULL AS usable FROM ei)"


def _leg(name: str, expiry: int, factor: float, jump: str, loaded: int, cfg: BacktestConfig) -> list[str]:
    dt = f"(1::DOUBLE / {cfg.periods_per_year})"
    safe = f"(CASE WHEN t < {expiry} THEN ({expiry} - t) * {dt} ELSE 1 END)"
    b = f"(baseline * {factor}::DOUBLE)"
    src = f"""SELECT ticker, pp, t, spot, strike, t < {expiry} AS alive, sqrt(greatest(1e-12, ({b} * {b} * {safe} + CASE WHEN t <= {loaded} THEN {jump} ELSE 0 END) / {safe})) AS vol, {safe} AS tau FROM grid"""
    return [
        f"{name}_m AS ({straddle(src, 'ticker, pp, t, spot, strike, alive, vol', cfg.rate)})",
        f"{name}_v AS (SELECT ticker, pp, t, spot, alive, vol, CASE WHEN alive THEN price ELSE abs(spot - strike) END AS value, delta FROM {name}_m)",
        f"""{name} AS (SELECT a.ticker, a.pp, sum(CASE WHEN a.alive THEN z.value - a.value - a.delta * (z.spot - a.spot) END) AS pnl,
  max(CASE WHEN a.t = 0 THEN a.value END) AS premium, max(CASE WHEN a.t = 0 THEN a.vol END) AS iv
  FROM {name}_v a LEFT JOIN {name}_v z ON z.ticker = a.ticker AND z.pp = a.pp AND z.t = a.t + 1 GROUP BY a.ticker, a.pp)""",
    ]


def trade_ctes(cfg: BacktestConfig, ev: DecompositionConfig, iv: float | str | None = None, iv_days: int | None = None, known: str = "true") -> list[str]:
    """CTEs up to ``trades``, with unrounded columns.  iv: a number or an expression; known: where it counts."""
    e, front, back = cfg.entry_offset, cfg.entry_offset + cfg.front_expiry_offset, cfg.entry_offset - cfg.back_expiry_offset
    calendar, slip = cfg.structure == "calendar", f"{cfg.slippage_vol_points}::DOUBLE"
    front_tau, back_tau = f"({front}::DOUBLE / {cfg.periods_per_year})", f"({back}::DOUBLE / {cfg.periods_per_year})"
    if iv is None:
        use, jump = "priceable AND calibration IS NOT NULL", f"pow(calibration / {MOVE}::DOUBLE, 2)"
    else:
        tau = front_tau if iv_days is None else f"({iv_days}::DOUBLE / {cfg.periods_per_year})"
        use, jump = f"priceable AND {known}", f"greatest(0, ({iv}::DOUBLE * {iv} - baseline * baseline) * {tau})"
    ctes = [
        *entry_ctes(cfg, ev),
        f"used AS (SELECT *, {jump} AS jump_var FROM ei WHERE {use})",
        f"grid AS (SELECT u.ticker, u.pp, y.pp - u.pp + {e} AS t, y.close AS spot, u.entry_spot AS strike, u.baseline, u.jump_var FROM used u JOIN s y ON y.ticker = u.ticker AND y.pp BETWEEN u.pp - {e} AND u.pp + {cfg.exit_offset})",
        *_leg("fr", front, 1.0, "jump_var", cfg.last_loaded_step(ev.event_window), cfg),
    ]
    if calendar:
        ctes += _leg("bk", back, cfg.back_iv_multiplier, "0", -1, cfg)
    else:
        ctes.append("bk AS (SELECT ticker, pp, 0::DOUBLE AS pnl, 0::DOUBLE AS premium, NULL::DOUBLE AS iv FROM used)")
    ctes.append("t0 AS (SELECT u.*, fr.pnl AS fp, fr.premium AS front_premium, fr.iv AS front_iv, bk.pnl AS back_pnl, bk.premium AS back_premium, bk.iv AS back_iv FROM used u JOIN fr USING (ticker, pp) JOIN bk USING (ticker, pp))")
    ctes.append(f"fx AS ({straddle(f'SELECT ticker, pp, entry_spot AS spot, entry_spot AS strike, greatest(front_iv - {slip}, 1e-6) AS vol, {front_tau} AS tau FROM t0', 'ticker, pp', cfg.rate)})")
    if calendar:
        ctes.append(f"bx AS ({straddle(f'SELECT ticker, pp, entry_spot AS spot, entry_spot AS strike, back_iv + {slip} AS vol, {back_tau} AS tau FROM t0', 'ticker, pp', cfg.rate)})")
    else:
        ctes.append("bx AS (SELECT ticker, pp, 0::DOUBLE AS price FROM t0)")
    ctes.append(
        f"""t1 AS (SELECT t0.*, fx.price AS front_entry_execution, bx.price AS back_entry_execution, fx.price - front_premium - (bx.price - back_premium) AS execution_adjustment,
  fx.price - bx.price AS net_credit, -fp AS front_pnl, -fp + back_pnl AS model_gross_pnl, (front_premium + back_premium) * ({cfg.transaction_cost_bps}::DOUBLE / 10000) AS cost
  FROM t0 JOIN fx USING (ticker, pp) JOIN bx USING (ticker, pp))"""
    )
    basis = {"front_premium": "front_premium", "net_credit": "CASE WHEN abs(net_credit) < 0.05 * front_premium THEN front_premium + back_premium ELSE abs(net_credit) END", "notional": "entry_spot"}[cfg.capital_basis]
    ctes.append(f"t2 AS (SELECT *, model_gross_pnl + execution_adjustment - cost AS net_pnl, {basis} AS capital_basis FROM t1)")
    ctes.append(
        f"""trades AS (SELECT ticker, session_date, announcement_date, entry_date, event_date, exit_date, entry_spot, exit_spot, entry_spot AS strike, baseline AS sigma_baseline, front_iv,
  sqrt(jump_var) * {MOVE}::DOUBLE AS implied_event_move, entry_date AS entry_baseline_date, history_events, back_iv, front_premium, back_premium, net_credit, front_entry_execution,
  back_entry_execution, model_gross_pnl, execution_adjustment, move AS realized_move, front_pnl, back_pnl, cost, net_pnl, capital_basis, net_pnl / capital_basis AS "return" FROM t2)"""
    )
    return ctes


TRADE_PLAIN = ("ticker", "session_date", "announcement_date", "entry_date", "event_date", "exit_date", "entry_baseline_date", "history_events")


def trades(cfg: BacktestConfig, ev: DecompositionConfig, columns: list[str], iv: float | str | None = None, iv_days: int | None = None, known: str = "true") -> str:
    return base(*trade_ctes(cfg, ev, iv, iv_days, known)) + f"SELECT {rounded(['ticker', 'session_date', *columns], TRADE_PLAIN)} FROM trades"


EQUITY = """eq AS (SELECT a.ticker, a.session_date, any_value(a."return") AS "return", 1 + sum(b."return" ORDER BY b.session_date) AS equity FROM trades a JOIN trades b
  ON b.ticker = a.ticker AND b.session_date <= a.session_date GROUP BY a.ticker, a.session_date),
eq2 AS (SELECT a.ticker, a.session_date, any_value(a."return") AS "return", any_value(a.equity) AS equity, greatest(1, max(b.equity)) AS peak, max(b.equity) AS running_peak FROM eq a JOIN eq b
  ON b.ticker = a.ticker AND b.session_date <= a.session_date GROUP BY a.ticker, a.session_date)"""


def compounded() -> str:
    """``EQUITY`` that compounds and ends, as null, with a return of -100 % or less."""
    grown = EQUITY.replace('1 + sum(b."return" ORDER BY b.session_date)', 'CASE WHEN min(b."return") > -1 THEN product(1 + b."return") END')
    return grown.replace("greatest(1, max(b.equity)) AS peak", "CASE WHEN any_value(a.equity) IS NOT NULL THEN greatest(1, max(b.equity)) END AS peak")


RATES = """gaps AS (SELECT ticker, date_diff('day', lag(session_date) OVER (PARTITION BY ticker ORDER BY session_date), session_date) AS gap FROM (SELECT DISTINCT ticker, session_date FROM {table})),
rates AS (SELECT ticker, CASE WHEN count(*) >= 3 THEN least(12, greatest(1, 365.25::DOUBLE / median(gap) FILTER (WHERE gap > 0))) ELSE 4 END::DOUBLE AS events_per_year FROM gaps GROUP BY ticker)"""

STATS = [
    "ticker", "n_trades", "win_rate", "mean_return", "median_return", "std_return", "sharpe_ratio", "profit_factor", "max_drawdown", "total_return", "best_trade", "worst_trade",
    "mean_net_credit", "mean_front_pnl", "mean_back_pnl", "mean_cost", "mean_implied_move", "mean_realized_move", "events_per_year",
]


def stats_ctes(compound: bool = False) -> list[str]:
    fall = "equity / peak - 1" if compound else "equity - peak"
    return [
        compounded() if compound else EQUITY,
        RATES.format(table="trades"),
        """st AS (SELECT ticker, count(*)::DOUBLE AS n_trades, avg(("return" > 0)::INT::DOUBLE) AS win_rate, avg("return") AS mean_return, median("return") AS median_return,
  coalesce(stddev_samp("return"), 0) AS std_return, CASE WHEN sum(greatest(-"return", 0)) > 0 THEN sum(greatest("return", 0)) / sum(greatest(-"return", 0))
  WHEN sum(greatest("return", 0)) > 0 THEN 'infinity'::DOUBLE END AS profit_factor, max("return") AS best_trade, min("return") AS worst_trade, avg(net_credit) AS mean_net_credit,
  avg(front_pnl) AS mean_front_pnl, avg(back_pnl) AS mean_back_pnl, avg(cost) AS mean_cost, avg(implied_event_move) AS mean_implied_move, avg(realized_move) AS mean_realized_move
  FROM trades GROUP BY ticker)""",
        f"dd AS (SELECT ticker, CASE WHEN count(equity) = count(*) THEN least(0, min({fall})) END AS max_drawdown, CASE WHEN count(equity) = count(*) THEN arg_max(equity, session_date) - 1 END AS total_return FROM eq2 GROUP BY ticker)",
        "stats AS (SELECT *, CASE WHEN std_return > 0 THEN mean_return / std_return * sqrt(events_per_year) END AS sharpe_ratio FROM st JOIN dd USING (ticker) JOIN rates USING (ticker))",
    ]
