"""Alignment and decomposition as SQL functions that return tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..config import DecompositionConfig
from .alignment import align_events
from .decomposition import decompose_events

_FUNCTIONS = {"aligned_events": (align_events, "announcement_date"), "decomposed_events": (decompose_events, "session_date")}


def register_table_functions(spark: SparkSession, bars: DataFrame, announcements: DataFrame, config: DecompositionConfig | None = None) -> None:
    """``aligned_events(who, first, last)`` and ``decomposed_events(who, first, last)`` for SQL text, over these bars.

    All arguments may be left out or null: a ticker, and the first and last day
    of the announcements, or of the events' sessions, that are returned.  They
    are plain predicates: one ticker's rows are sought in the scan, before the
    frames, and days after them, as frames need what lies before.
    """
    for name, (operator, day) in _FUNCTIONS.items():
        rows = operator(bars, announcements, config)
        rows.createOrReplaceTempView(f"varsight_{name}")
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        chosen = f"(who IS NULL OR ticker = who) AND (first IS NULL OR {day} >= first) AND (last IS NULL OR {day} <= last)"
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(who STRING DEFAULT NULL, first DATE DEFAULT NULL, last DATE DEFAULT NULL) RETURNS TABLE ({columns}) RETURN SELECT * FROM varsight_{name} WHERE {chosen}"
        )
