"""Placing announcement dates on the session grid: a forward as-of join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DecompositionConfig
from ..errors import AlignmentError, MissingEventsError
from ..functions.windows import by_session, by_ticker, positioned

ALIGNED, FUTURE, SHORT, DUPLICATE = "aligned", "future", "insufficient", "duplicate"


def announcement_set(announcements: DataFrame) -> DataFrame:
    """Distinct ``(ticker, announcement_date)`` without nulls."""
    return announcements.select("ticker", F.to_date("announcement_date").alias("announcement_date")).dropna().distinct()


def session_slots(sessions: DataFrame, cfg: DecompositionConfig, payload: list[str], keep: list[str] | None = None) -> DataFrame:
    """What an announcement takes from the session it falls on: ``(ticker, date, kind, slot)``, for sessions with a return."""
    at = F.struct(*payload)
    if cfg.announcement_offset:
        at = F.lead(at, cfg.announcement_offset).over(by_session())
    slot = F.struct((F.col("pp") - 1).alias("position"), at.alias("at"))
    return sessions.withColumn("slot", slot).where("pp >= 1").select("ticker", "date", F.lit(1).alias("kind"), "slot", *(keep or []))


def place(slots: DataFrame, dates: DataFrame, cfg: DecompositionConfig, n_returns: Column) -> DataFrame:
    """Announcements ``(ticker, date, kind)`` with the next slot of their ticker, and status and reason."""
    stream = slots.unionByName(dates, allowMissingColumns=True)
    back = Window.partitionBy("ticker").orderBy(F.desc("date"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    found = stream.withColumn("slot", F.last("slot", ignorenulls=True).over(back)).withColumn("n_returns", n_returns)
    found = found.where("kind = 0 and n_returns > 0").withColumn("return_position", F.coalesce("slot.position", "n_returns") + cfg.announcement_offset)
    p, n = F.col("return_position"), F.col("n_returns")
    reason = (
        F.when(p >= n, "after the last session")
        .when(p < cfg.back_need, f"needs {cfg.back_need} sessions before the event")
        .when(p + cfg.forward_need > n, f"needs {cfg.forward_need} sessions from the event")
    )
    found = found.withColumn("drop_reason", reason).withColumn("early", F.when(p >= n, FUTURE).when(reason.isNotNull(), SHORT))
    order = Window.partitionBy("ticker", "return_position", "early").orderBy("date")
    again = F.col("early").isNull() & (F.row_number().over(order) > 1)
    found = found.withColumn("again", again)
    status = F.coalesce("early", F.when(F.col("again"), DUPLICATE), F.lit(ALIGNED))
    reason = F.when(F.col("again"), "same session as an earlier announcement").otherwise(F.col("drop_reason"))
    return found.select("ticker", F.col("date").alias("announcement_date"), "return_position", status.alias("status"), reason.alias("drop_reason"), F.col("slot.at").alias("at"))


def placed_announcements(sessions: DataFrame, announcements: DataFrame, cfg: DecompositionConfig, payload: list[str], partitions: int | None = None) -> DataFrame:
    """Every announcement with ``return_position``, status, reason and the payload of its session.

    ``sessions`` come from ``positioned``.  Sessions and announcements are one
    sorted stream per ticker, read from the latest date back, so that each
    announcement takes the last session met, and with it the columns named in
    ``payload``: an as-of join by one running frame, after which no other join
    is needed.  Announcements of tickers without sessions drop out.

    The few announcements are dealt by ticker as the sessions already are, to
    ``partitions`` where those are in buckets, so that the stream of both needs
    no exchange and sessions stay where they are.
    """
    dates = announcement_set(announcements).select("ticker", F.col("announcement_date").alias("date"), F.lit(0).alias("kind"))
    dates = dates.repartition(partitions, "ticker") if partitions else dates.repartition("ticker")
    return place(session_slots(sessions, cfg, payload), dates, cfg, F.sum("kind").over(by_ticker()))


def align_events(bars: DataFrame, announcements: DataFrame, config: DecompositionConfig | None = None, strict: bool = False) -> DataFrame:
    """Every announcement with its return position, session date, status and reason.

    Status is ``future`` past the last session, ``insufficient`` where windows
    leave the history (too early before too late), ``duplicate`` where an
    earlier announcement has the session already, else ``aligned``.  ``strict``
    raises if anything was not aligned, or nothing was.
    """
    cfg = config or DecompositionConfig()
    placed = placed_announcements(positioned(bars), announcements, cfg, ["date"])
    session = F.when(F.col("status") != FUTURE, F.col("at.date"))
    out = placed.select("ticker", "announcement_date", "return_position", session.alias("session_date"), "status", "drop_reason")
    if strict:
        _raise_on_drops(out)
    return out


def _raise_on_drops(status: DataFrame) -> None:
    counts = {r["status"]: r["count"] for r in status.groupBy("status").count().collect()}
    if not counts.get(ALIGNED):
        raise MissingEventsError("no announcement could be aligned")
    dropped = sum(n for k, n in counts.items() if k != ALIGNED)
    if dropped:
        raise AlignmentError(f"strict alignment: {dropped} announcement(s) were dropped")


def aligned_events(bars: DataFrame, announcements: DataFrame, config: DecompositionConfig | None = None) -> DataFrame:
    status = align_events(bars, announcements, config)
    return status.where(F.col("status") == ALIGNED).select("ticker", "announcement_date", "return_position", "session_date")


def alignment_counts(status: DataFrame) -> DataFrame:
    """Per ticker, how many announcements ended in each status."""
    kinds = (ALIGNED, FUTURE, SHORT, DUPLICATE)
    return status.groupBy("ticker").agg(*[F.count(F.when(F.col("status") == k, 1)).alias(f"n_{k}") for k in kinds])


def describe(status: DataFrame) -> DataFrame:
    """``(ticker, description)``: how many announcements were aligned and why others were not, as text."""
    counts = alignment_counts(status)
    parts = {DUPLICATE: "on a session that another has", SHORT: "without enough sessions around", FUTURE: "after the last session"}
    left = [F.when(F.col(f"n_{k}") > 0, F.format_string(f"%d {words}", f"n_{k}")) for k, words in parts.items()]
    lost = F.concat_ws(", ", *left)
    return counts.select("ticker", F.concat(F.format_string("%d aligned", f"n_{ALIGNED}"), F.when(lost != "", F.concat(F.lit("; dropped: "), lost)).otherwise("")).alias("description"))
