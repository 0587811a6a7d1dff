"""Streaming input for the batch operators (an addition of this package)."""
