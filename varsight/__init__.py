"""Event-variance analytics and corpus processing on Spark DataFrames."""

__version__ = "0.2.0"

from .config import BacktestConfig, DecompositionConfig
from .errors import AlignmentError, BacktestError, CacheError, DataError, InsufficientDataError, MissingEventsError, SchemaError, SourceError, VarsightError
from .functions.expressions import annualize, bs_straddle, implied_jump_move, norm_cdf, norm_pdf, register_sql_functions
from .operators.alignment import align_events, aligned_events, alignment_counts
from .operators.backtest import BacktestResult, equity_curve, events_per_year, run_backtest, summary_table, trade_stats
from .operators.cone import vol_cone
from .operators.decomposition import decompose_events, summarize
from .operators.estimators import REGISTRY, close_to_close, log_returns, parkinson, realized_variance, rolling_close_to_close, rolling_parkinson, rolling_yang_zhang, yang_zhang
from .operators.premium import PremiumResult, volatility_risk_premium
from .operators.quality import MAX_HOLIDAY_RUN, OHLCV, detect_gaps, validate_ohlcv, violations
from .operators.report import cross_section, decomposition_timeline, event_table, jump_histogram, jump_summary, pnl_chart, premium_scatter, stage_status
from .session import build_session
from .sources.store import clear_store, read_store, save_figure, through_store, write_store
from .sources.tables import load_events, load_prices, read_event_csv, read_price_csv, read_price_parquet, read_universe

__all__ = [name for name in dir() if not name.startswith("_")]
