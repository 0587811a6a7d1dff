"""The session operators over histories that are too long for one task.

The plain operators keep a ticker's sessions in one window partition.  Here a
ticker is cut into blocks of sessions, and a block is a window partition.

Positions are carried: sessions are counted in narrow buckets of time, the few
counts are summed along each ticker, and a session's position is the sum before
its bucket plus its place within it.  Blocks are then cut by position, so all of
a ticker's but the last hold the same number of sessions, and each gets copies
of the sessions before and after it that its frames reach: its halo.  Frames are
those of the plain operators, as a block stands where they expect a ticker; rows
of the halo are dropped afterwards.

Running totals need all that came before.  They are scanned in two levels:
within each block, then over the blocks' totals, whose prefix is handed back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import PERIODS_PER_YEAR, DecompositionConfig
from ..functions.expressions import annualize
from ..functions.windows import by_session
from .alignment import FUTURE, announcement_set, place, session_slots
from .cone import QUANTILES, WINDOWS, checked_windows, stacked_windows
from .decomposition import event_columns, event_payload, session_frames
from .estimators import rolling_variance
from .quantiles import SelectConfig, exact_quantiles, settled


@dataclass(frozen=True)
class BlockConfig:
    """rows: sessions of a block; at least as many as a frame reaches.  grain:
    buckets of time for each block of the longest ticker.
    """

    rows: int = 250_000
    grain: int = 16

    def __post_init__(self) -> None:
        if self.rows < 2 or self.grain < 1:
            raise ValueError("a block needs 2 rows or more, and a grain of 1 or more")


DEFAULT = BlockConfig()


def _ticks(df: DataFrame, order: str) -> str:
    """SQL of a date or time as a whole number."""
    return f"CAST({'unix_date' if isinstance(df.schema[order].dataType, T.DateType) else 'unix_micros'}(`{order}`) AS BIGINT)"


def carried_positions(df: DataFrame, order: str = "date", cfg: BlockConfig = DEFAULT) -> DataFrame:
    """``df`` with ``pp`` (place along ``order`` from 0) and ``n_sessions`` of each ticker.

    One aggregation finds the span of time and the longest ticker, which alone
    go to the driver.  Rows are shuffled by ticker and bucket, and meet there the
    number of rows before the bucket.  ``df`` is read three times.
    """
    t = F.expr(_ticks(df, order))
    each = df.groupBy("ticker").agg(F.min(t).alias("lo"), F.max(t).alias("hi"), F.count(F.lit(1)).alias("n"))
    lo, hi, most = each.agg(F.min("lo"), F.max("hi"), F.max("n")).first()
    buckets = -(-(most or 1) // cfg.rows) * cfg.grain
    width = max(1, -(-((hi or 0) - (lo or 0) + 1) // buckets))
    rows = df.withColumn("_bucket", F.expr(f"({_ticks(df, order)} - {lo or 0}L) div {width}L"))
    counts = rows.groupBy("ticker", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    along = Window.partitionBy("ticker").orderBy("_bucket")
    before = F.coalesce(F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("ticker", "_bucket", before.alias("_before"), F.sum("_n").over(Window.partitionBy("ticker")).alias("n_sessions"))
    rows = rows.join(counts.hint("shuffle_hash"), ["ticker", "_bucket"])
    within = F.row_number().over(Window.partitionBy("ticker", "_bucket").orderBy(order))
    return rows.withColumn("pp", (F.col("_before") + within - 1).cast("long")).drop("_bucket", "_before")


def in_blocks(positioned: DataFrame, back: int, forward: int, cfg: BlockConfig = DEFAULT) -> DataFrame:
    """Rows by block, in place of the ticker: ``ticker`` is a struct of its ``name`` and ``block``.

    ``back`` and ``forward`` sessions around a block are copied into it; ``home``
    marks a row's own block.
    """
    size = max(cfg.rows, back, forward)
    own = F.expr(f"pp div {size}L")
    next_too = (F.col("pp") >= (own + 1) * size - back) & ((own + 1) * size < F.col("n_sessions"))
    last_too = (F.col("pp") < own * size + forward) & (own > 0)
    blocks = F.filter(F.array(own, F.when(next_too, own + 1), F.when(last_too, own - 1)), lambda b: b.isNotNull())
    rows = positioned.withColumn("_own", own).withColumn("_block", F.explode(blocks))
    rows = rows.withColumn("ticker", F.struct(F.col("ticker").alias("name"), F.col("_block").alias("block")))
    return rows.withColumn("home", F.col("_own") == F.col("_block")).drop("_own", "_block")


def at_home(df: DataFrame) -> DataFrame:
    """Rows in their own blocks, by ticker again."""
    return df.where("home").withColumn("ticker", F.col("ticker.name")).drop("home")


def _with_returns(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("r", F.ln("close") - F.lag(F.ln("close")).over(by_session()))


def log_returns(bars: DataFrame, cfg: BlockConfig = DEFAULT) -> DataFrame:
    """As ``estimators.log_returns``."""
    rows = at_home(_with_returns(in_blocks(carried_positions(bars, cfg=cfg), 1, 0, cfg))).where("pp >= 1")
    return rows.select("ticker", "date", (F.col("pp") - 1).alias("ret_pos"), F.col("r").alias("log_return"))


def rolling_volatility(
    bars: DataFrame,
    estimator: str,
    window: int,
    annualized: bool = True,
    zero_mean: bool = False,
    ddof: int = 1,
    periods_per_year: float = PERIODS_PER_YEAR,
    cfg: BlockConfig = DEFAULT,
) -> DataFrame:
    """``(ticker, date, pp, n_sessions, sigma)``, as the rolling estimators have it."""
    blocks = _with_returns(in_blocks(carried_positions(bars, cfg=cfg), window + 1, 0, cfg))
    rows = at_home(rolling_variance(blocks, estimator, window, "_v", zero_mean, ddof))
    return rows.select("ticker", "date", "pp", "n_sessions", annualize(F.sqrt("_v"), periods_per_year, annualized).alias("sigma"))


def _dealt_announcements(frames: DataFrame, announcements: DataFrame) -> DataFrame:
    """Announcements with the block that holds the next session, or the last block after all sessions.

    Blocks' last dates and announcements are one sorted stream by ticker; it has
    no bars.
    """
    ends = frames.where("home").groupBy("ticker").agg(F.max("date").alias("date"), F.first("n_sessions").alias("n_sessions"))
    ends = ends.select(F.col("ticker.name").alias("ticker"), "date", F.lit(1).alias("kind"), F.struct(F.col("ticker.block").alias("block"), (F.col("n_sessions") - 1).alias("n_returns")).alias("at"))
    dates = announcement_set(announcements).select("ticker", F.col("announcement_date").alias("date"), F.lit(0).alias("kind"))
    back = Window.partitionBy("ticker").orderBy(F.desc("date"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("ticker")
    found = ends.unionByName(dates, allowMissingColumns=True)
    at = F.coalesce(F.last("at", ignorenulls=True).over(back), F.max("at").over(whole))
    found = found.withColumn("at", at).where("kind = 0 and at is not null")
    return found.select(F.struct(F.col("ticker").alias("name"), F.col("at.block").alias("block")).alias("ticker"), "date", "kind", F.col("at.n_returns").alias("n_returns"))


def _placed(frames: DataFrame, announcements: DataFrame, cfg: DecompositionConfig, payload: list[str]) -> DataFrame:
    """As ``alignment.placed_announcements``, a block at a time; a session's date must be a DATE."""
    slots = session_slots(frames, cfg, payload, keep=["home"]).where("home").drop("home")
    placed = place(slots, _dealt_announcements(frames, announcements), cfg, F.col("n_returns"))
    return placed.withColumn("ticker", F.col("ticker.name"))


def _frames(bars: DataFrame, cfg: DecompositionConfig, blocks: BlockConfig) -> DataFrame:
    reach = cfg.forward_need + cfg.announcement_offset + 1
    return session_frames(_with_returns(in_blocks(carried_positions(bars, cfg=blocks), cfg.back_need + 2, reach, blocks)), cfg)


def align_events(bars: DataFrame, announcements: DataFrame, config: DecompositionConfig | None = None, blocks: BlockConfig = DEFAULT) -> DataFrame:
    """As ``alignment.align_events``."""
    cfg = config or DecompositionConfig()
    rows = in_blocks(carried_positions(bars, cfg=blocks), 1, cfg.announcement_offset + 1, blocks)
    placed = _placed(rows, announcements, cfg, ["date"])
    session = F.when(F.col("status") != FUTURE, F.col("at.date"))
    return placed.select("ticker", "announcement_date", "return_position", session.alias("session_date"), "status", "drop_reason")


def decompose_events(bars: DataFrame, announcements: DataFrame, config: DecompositionConfig | None = None, blocks: BlockConfig = DEFAULT) -> DataFrame:
    """As ``decomposition.decompose_events``.  Bars are shuffled twice, by bucket and by block, and never by ticker alone."""
    cfg = config or DecompositionConfig()
    return event_columns(_placed(_frames(bars, cfg, blocks), announcements, cfg, event_payload(cfg)), cfg)


def equity_curve(trades: DataFrame, compound: bool = False, cfg: BlockConfig = DEFAULT) -> DataFrame:
    """As ``backtest.equity_curve``: running equity, peak and drawdown, scanned in two levels.

    A block's summary is its total return and the peak of its own curve, from
    which the equity and the peak at its start follow for all blocks: totals add
    (or multiply), and a later block's peak is moved by what came before.
    """
    returns = settled(trades.select("ticker", "session_date", "return"))
    rows = in_blocks(carried_positions(returns, "session_date", cfg), 0, 0, cfg)
    so_far = by_session().rowsBetween(Window.unboundedPreceding, 0)
    r = F.col("return")
    none, join, over = (1.0, lambda a, b: a * b, F.product) if compound else (0.0, lambda a, b: a + b, F.sum)
    own = F.coalesce(over(1 + r if compound else r).over(so_far), F.lit(none))
    rows = rows.withColumns({"own": own, "seen": F.count(r).over(so_far), "least": F.min(r).over(so_far)})
    # a curve has no point before its first return
    rows = rows.withColumn("own_peak", F.max(F.when(F.col("seen") > 0, F.col("own"))).over(so_far))

    total = F.max_by("own", "pp").alias("total")
    blocks = rows.groupBy("ticker").agg(total, F.max("own_peak").alias("top"), F.count(r).alias("n"), F.min(r).alias("worst"))
    blocks = blocks.withColumns({"name": F.col("ticker.name"), "block": F.col("ticker.block")})
    before = Window.partitionBy("name").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("start", F.coalesce(over("total").over(before), F.lit(none)))
    blocks = blocks.withColumns({"peak_before": F.max(join(F.col("start"), F.col("top"))).over(before), "n_before": F.coalesce(F.sum("n").over(before), F.lit(0)), "worst_before": F.min("worst").over(before)})
    blocks = blocks.select("ticker", "start", "peak_before", "n_before", "worst_before")
    rows = rows.join(blocks, "ticker")
    first = 0.0 if compound else 1.0
    started = F.col("seen") + F.col("n_before") > 0
    alive = F.least("least", "worst_before") > -1 if compound else F.lit(True)
    equity = F.when(started & alive, join(F.col("start"), F.col("own")) + first)
    peak = F.greatest(F.lit(1.0), F.col("peak_before") + first, join(F.col("start"), F.col("own_peak")) + first)
    rows = rows.withColumn("equity", equity).withColumn("peak", F.when(F.col("equity").isNotNull(), peak))
    rows = rows.withColumn("drawdown", F.col("equity") / F.col("peak") - 1 if compound else F.col("equity") - F.col("peak"))
    return at_home(rows).select("ticker", "session_date", "return", "equity", "peak", "drawdown")


def vol_cone(
    bars: DataFrame,
    windows=WINDOWS,
    quantiles=QUANTILES,
    estimator: str = "close_to_close",
    annualized: bool = True,
    blocks: BlockConfig = DEFAULT,
    select: SelectConfig | None = None,
) -> DataFrame:
    """As ``cone.vol_cone``, with quantiles that are selected by counting instead of gathered."""
    windows = checked_windows(windows, quantiles, estimator)
    rows = _with_returns(in_blocks(carried_positions(bars, cfg=blocks), windows[-1] + 1, 0, blocks))
    stacked = stacked_windows(rows, windows, estimator, annualized, keep=["home"])
    stacked = at_home(stacked)
    found = exact_quantiles(stacked, ["ticker", "window"], "sigma", quantiles, select or SelectConfig())
    named = [F.col("quantiles")[k].alias(f"q{round(q * 100):02d}") for k, q in enumerate(quantiles)]
    rest = stacked.groupBy("ticker", "window").agg(F.max_by("sigma", "pp").alias("last"), F.count("sigma").alias("n_obs"))
    return found.select("ticker", "window", *named).join(rest, ["ticker", "window"])
