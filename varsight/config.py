"""Settings of decomposition and backtest; each field declares what it may hold."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, fields
from typing import Any

from .errors import BacktestError

PERIODS_PER_YEAR = 252
ESTIMATORS = ("close_to_close", "parkinson", "yang_zhang")
STRUCTURES = ("calendar", "short_straddle")
CAPITAL_BASES = ("front_premium", "net_credit", "notional")


def _setting(default: Any, **bounds: Any) -> Any:
    """A field and its bounds: ``least``, ``above``, ``most``, ``among``; of a tuple they hold for every member."""
    return field(default=default, metadata=bounds)


_TESTS = {
    "least": (lambda v, b: v >= b, "must be >= {}"),
    "above": (lambda v, b: v > b, "must be > {}"),
    "most": (lambda v, b: v <= b, "must be <= {}"),
    "among": (lambda v, b: v in b, "must be one of {}"),
}


def _problems(settings: Any) -> list[str]:
    """What fields hold beyond their bounds."""
    found = []
    for f in fields(settings):
        held = getattr(settings, f.name)
        values = held if isinstance(held, tuple) else () if held is None else (held,)
        if held == ():
            found.append(f"{f.name} must not be empty")
        if any(isinstance(v, float) and not math.isfinite(v) for v in values):
            found.append(f"{f.name} must be finite")
        for name, bound in f.metadata.items():
            test, words = _TESTS[name]
            if not all(test(v, bound) for v in values):
                found.append(f"{f.name} {words.format(bound)}")
    return found


@dataclass(frozen=True)
class DecompositionConfig:
    """Windows are in sessions; the first baseline window is the primary one."""

    baseline_windows: tuple[int, ...] = _setting((20, 30, 60), least=2)
    event_window: int = _setting(2, least=1)
    post_windows: tuple[int, ...] = _setting((5, 10), least=1)
    baseline_gap: int = _setting(0, least=0)
    announcement_offset: int = _setting(0, least=0)
    estimator: str = _setting("close_to_close", among=ESTIMATORS)
    zero_mean: bool = True
    ddof: int = _setting(0, least=0)
    annualized: bool = True
    periods_per_year: int = _setting(PERIODS_PER_YEAR, above=0)

    def __post_init__(self) -> None:
        for name in ("baseline_windows", "post_windows"):
            object.__setattr__(self, name, tuple(int(w) for w in getattr(self, name)))
        for problem in _problems(self):
            raise ValueError(problem)

    @classmethod
    def prototype(cls) -> DecompositionConfig:
        """One window of 20, variances about the mean, not annualized."""
        return cls(baseline_windows=(20,), zero_mean=False, annualized=False)

    @property
    def primary_baseline(self) -> int:
        return self.baseline_windows[0]

    @property
    def scale(self) -> float:
        """What a per-session volatility is multiplied by."""
        return math.sqrt(self.periods_per_year) if self.annualized else 1.0

    @property
    def back_need(self) -> int:
        return self.baseline_gap + max(self.baseline_windows)

    @property
    def forward_need(self) -> int:
        return max(self.event_window, 1 + max(self.post_windows))


@dataclass(frozen=True)
class BacktestConfig:
    """Offsets are in sessions from the event session.

    A calendar is short a straddle that expires after the event and long one
    that expires before it; ``short_straddle`` has the first leg alone.  Hedges
    are daily at the close, so ``hedge_band`` is 0.
    """

    structure: str = _setting("calendar", among=STRUCTURES)
    entry_offset: int = _setting(5, least=1)
    exit_offset: int = _setting(1, least=0)
    front_expiry_offset: int = 3
    back_expiry_offset: int = 3
    min_history_events: int = _setting(2, least=1)
    implied_move_multiplier: float = _setting(1.0, above=0)
    back_iv_multiplier: float = _setting(1.0, above=0)
    hedge_band: float = _setting(0.0, among=(0,))
    transaction_cost_bps: float = _setting(25.0, least=0)
    slippage_vol_points: float = _setting(0.0, least=0)
    rate: float = 0.0
    capital_basis: str = _setting("front_premium", among=CAPITAL_BASES)
    compound: bool = False
    events_per_year: float | None = _setting(None, above=0)
    periods_per_year: int = _setting(PERIODS_PER_YEAR, least=1)

    def __post_init__(self) -> None:
        problems = _problems(self)
        if self.front_expiry_offset <= self.exit_offset:
            problems.append("front_expiry_offset must exceed exit_offset")
        if self.structure == "calendar" and not 1 <= self.back_expiry_offset < self.entry_offset:
            problems.append("back_expiry_offset must be >= 1 and below entry_offset")
        for problem in problems:
            raise BacktestError(problem)

    @property
    def holding_sessions(self) -> int:
        return self.entry_offset + self.exit_offset

    @property
    def back_need(self) -> int:
        return max(self.entry_offset, self.back_expiry_offset if self.structure == "calendar" else 0)

    @property
    def forward_need(self) -> int:
        return max(self.exit_offset, self.front_expiry_offset)

    @property
    def dt(self) -> float:
        return 1.0 / self.periods_per_year

    def last_loaded_step(self, event_window: int) -> int:
        """The last path step that still has the event's variance ahead.

        The steps before and within the event window have; the path ends one
        step before the exit.
        """
        first, last = self.entry_offset - 1, self.entry_offset + event_window - 2
        held = self.holding_sessions - 1
        if first > min(last, held):
            raise BacktestError("the event window does not intersect the holding path; increase exit_offset")
        return min(last, held)
