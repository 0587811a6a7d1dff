"""Readers of bars, event dates and ticker lists, and writers of results."""
