"""Errors of the analytics operators."""

from __future__ import annotations


class VarsightError(Exception):
    """Root of all errors raised here."""


class DataError(VarsightError):
    """The input data cannot be used."""


class SourceError(DataError):
    """A source gave no rows."""


class SchemaError(DataError):
    """Rows break the rules of their table; ``violations`` lists how."""

    def __init__(self, message: str, violations: list[str] | None = None):
        self.violations = list(violations or [])
        super().__init__(message + (f" Violations: {'; '.join(self.violations)}" if self.violations else ""))


class InsufficientDataError(DataError):
    """A history is shorter than the windows asked for."""

    def __init__(self, message: str, required: int | None = None, available: int | None = None):
        self.required, self.available = required, available
        super().__init__(message + (f" (required={required}, available={available})" if required is not None else ""))


class MissingEventsError(DataError):
    """No event date is left to work on."""


class CacheError(DataError):
    """A stored table cannot be read."""


class AlignmentError(VarsightError):
    """Event dates cannot be placed on the session grid."""


class BacktestError(VarsightError):
    """A backtest's settings or inputs are inconsistent."""
