"""Variance around each event, split into a quiet baseline and a jump."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DecompositionConfig
from ..errors import InsufficientDataError, SchemaError
from ..functions.windows import by_session, full, positioned, variance
from .alignment import ALIGNED, placed_announcements
from .estimators import LINEAR_FROM, rolling_variance


def _largest_move(window: int) -> Column:
    """The return of largest size among this and the next sessions; the first of equals."""
    best = F.col("r")
    for j in range(1, window):
        x = F.lead("r", j).over(by_session())
        best = F.when(F.abs(x) > F.abs(best), x).otherwise(best)
    return best


def _check(bars: DataFrame, cfg: DecompositionConfig, strict: bool) -> None:
    needed = ["close"] if cfg.estimator == "close_to_close" else ["open", "high", "low", "close"]
    missing = [c for c in needed if c not in bars.columns]
    if missing:
        raise SchemaError(f"estimator {cfg.estimator} needs columns that are missing.", [f"missing '{c}'" for c in missing])
    if strict:
        need = cfg.back_need + cfg.forward_need + 1
        short = bars.groupBy("ticker").count().where(F.col("count") < need).first()
        if short is not None:
            raise InsufficientDataError(f"history of {short['ticker']} is shorter than its windows", required=need, available=short["count"])


def session_frames(df: DataFrame, cfg: DecompositionConfig) -> DataFrame:
    """All frames of the decomposition at every session of ``df`` from ``positioned``, in one pass by ticker.

    Long baselines are gathered at a cost that does not grow with their length.
    """
    zero, ddof, gap = cfg.zero_mean, cfg.ddof, cfg.baseline_gap
    event = by_session().rowsBetween(0, cfg.event_window - 1)
    r = F.col("r")
    columns = {"v_total": variance(r, zero, ddof, event), "event_sum": F.sum("r").over(event), "event_return": _largest_move(cfg.event_window)}
    for w in cfg.baseline_windows:
        if cfg.estimator == "close_to_close" and w < LINEAR_FROM:
            frame = by_session().rowsBetween(-(gap + w), -(gap + 1))
            columns[f"v_base_{w}"] = full(variance(r, zero, ddof, frame), r, frame, w)
        else:
            df = rolling_variance(df, cfg.estimator, w, f"_roll_{w}", zero, ddof)
            columns[f"v_base_{w}"] = F.lag(f"_roll_{w}", gap + 1).over(by_session())
    for k in cfg.post_windows:
        frame = by_session().rowsBetween(1, k)
        columns[f"v_post_{k}"] = full(variance(r, zero, ddof, frame), r, frame, k)
    return df.withColumns(columns)


def session_variances(bars: DataFrame, cfg: DecompositionConfig) -> DataFrame:
    """``session_frames`` of plain bars."""
    return session_frames(positioned(bars), cfg)


def decompose_events(bars: DataFrame, announcements: DataFrame, config: DecompositionConfig | None = None, strict: bool = False, partitions: int | None = None) -> DataFrame:
    """One row per aligned event, with its volatilities and moves.

    The jump is what total variance exceeds the primary baseline by; where it
    falls short the jump is 0 and ``jump_clamped``.  Volatilities are annualized
    if the settings say so, ``var_jump_raw`` and returns never are.  Bars stored
    in buckets by ticker (``sources.buckets``) are not shuffled where
    ``partitions`` is the number of buckets.
    """
    cfg = config or DecompositionConfig()
    _check(bars, cfg, strict)
    return event_columns(placed_announcements(session_variances(bars, cfg), announcements, cfg, event_payload(cfg), partitions), cfg)


def event_payload(cfg: DecompositionConfig) -> list[str]:
    """What an event takes from its session."""
    return ["date", "close", "v_total", "event_sum", "event_return", *[f"v_base_{w}" for w in cfg.baseline_windows], *[f"v_post_{k}" for k in cfg.post_windows]]


def event_columns(placed: DataFrame, cfg: DecompositionConfig) -> DataFrame:
    """The event frame of placed announcements: of those that are aligned, with the jump and in the units asked for."""
    rows = placed.where(F.col("status") == ALIGNED).select("ticker", "announcement_date", "return_position", "at.*").withColumnRenamed("date", "session_date")
    base = F.col(f"v_base_{cfg.primary_baseline}")
    raw = F.col("v_total") - base
    s = cfg.scale
    columns = [F.col(c) for c in ("ticker", "session_date", "announcement_date", "return_position", "close")]
    columns += [(F.sqrt("v_total") * s).alias("sigma_total")]
    columns += [(F.sqrt(f"v_base_{w}") * s).alias(f"sigma_baseline_{w}") for w in cfg.baseline_windows]
    columns += [
        (F.sqrt(base) * s).alias("sigma_baseline"),
        (F.sqrt(F.greatest(raw, F.lit(0.0))) * s).alias("sigma_jump"),
        raw.alias("var_jump_raw"),
        (raw < 0).alias("jump_clamped"),
        F.when(base > 0, F.col("v_total") / base).alias("variance_ratio"),
    ]
    columns += [(F.sqrt(f"v_post_{k}") * s).alias(f"sigma_post_{k}") for k in cfg.post_windows]
    columns += [F.col("event_return"), F.abs("event_return").alias("abs_event_return"), F.col("event_sum").alias("event_window_log_return")]
    return rows.select(*columns)


def summarize(events: DataFrame) -> DataFrame:
    """Means, medians and rates of an event frame by ticker."""
    posts = [c for c in events.columns if c.startswith("sigma_post_")]
    return events.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.avg("sigma_jump").alias("mean_sigma_jump"),
        F.median("sigma_jump").alias("median_sigma_jump"),
        F.avg("sigma_baseline").alias("mean_sigma_baseline"),
        F.avg("sigma_total").alias("mean_sigma_total"),
        F.avg("abs_event_return").alias("mean_abs_event_return"),
        F.median("abs_event_return").alias("median_abs_event_return"),
        F.avg("variance_ratio").alias("mean_variance_ratio"),
        F.avg(F.col("jump_clamped").cast("double")).alias("clamp_rate"),
        F.avg((F.col("event_return") < 0).cast("double")).alias("downside_share"),
        *[F.avg(c).alias(f"mean_{c}") for c in posts],
    )
