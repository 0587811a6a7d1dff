"""Validation of bars and search for gaps in their sessions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InsufficientDataError, SchemaError
from ..functions.expressions import clean

PRICES = ("open", "high", "low", "close")
OHLCV = (*PRICES, "volume")
MAX_HOLIDAY_RUN = 4


def coerce_bars(raw: DataFrame, columns: tuple[str, ...] = OHLCV) -> DataFrame:
    """Project to the columns needed, with dates and numbers made of what can be one."""
    missing = [c for c in ("ticker", "date", *columns) if c not in raw.columns]
    if missing:
        raise SchemaError("bars lack columns.", [f"missing '{c}'" for c in missing])
    return raw.select("ticker", F.to_date("date").alias("date"), *[clean(F.col(c).try_cast("double")).alias(c) for c in columns])


def _wrong(name: str, condition: Column) -> list[Column]:
    hit = F.coalesce(condition, F.lit(False))
    return [F.count(F.when(hit, 1)).alias(f"n_{name}"), F.min(F.when(hit, F.col("date"))).alias(f"first_{name}")]


def _whole() -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in PRICES])


def row_rules(allow_zero_volume: bool = True) -> dict[str, Column]:
    """By name, what is wrong with a row that has all prices; null counts as right."""
    rules = {f"nonpositive_{c}": F.col(c) <= 0 for c in PRICES}
    rules["high_below_low"] = F.col("high") < F.col("low")
    rules |= {f"{c}_outside": (F.col(c) < F.col("low")) | (F.col(c) > F.col("high")) for c in ("open", "close")}
    rules["negative_volume"] = F.col("volume") < 0
    rules["zero_volume"] = F.lit(False) if allow_zero_volume else F.col("volume") == 0
    return {name: _whole() & rule for name, rule in rules.items()}


def violations(bars: DataFrame, allow_zero_volume: bool = True) -> DataFrame:
    """A row per ticker with counts of every broken rule, in one aggregation.

    Rows without all prices count as ``n_incomplete`` and under no other price rule.
    """
    rows = bars.withColumn("_copies", F.count(F.lit(1)).over(Window.partitionBy("ticker", "date")))
    whole = _whole()
    checks = [F.count(F.lit(1)).alias("n_rows"), F.count(F.when(whole, 1)).alias("n_complete"), F.count(F.when(~whole, 1)).alias("n_incomplete")]
    checks += _wrong("duplicated", F.col("_copies") > 1)
    for name, rule in row_rules(allow_zero_volume).items():
        checks += _wrong(name, rule)
    return rows.groupBy("ticker").agg(*checks)


_LABELS = {
    "duplicated": "duplicated dates",
    **{f"nonpositive_{c}": f"non-positive {c}" for c in PRICES},
    "high_below_low": "High < Low",
    "open_outside": "Open outside [Low, High]",
    "close_outside": "Close outside [Low, High]",
    "negative_volume": "negative volume",
    "zero_volume": "zero volume",
}


def with_verdict(found: DataFrame, min_rows: int = 2) -> DataFrame:
    """Adds ``problems`` (texts) and ``valid`` to ``violations``."""
    texts = [F.when(F.col(f"n_{k}") > 0, F.concat(F.lit(f"{label}: "), F.col(f"n_{k}").cast("string"), F.lit(", first "), F.coalesce(F.col(f"first_{k}").cast("string"), F.lit("?")))) for k, label in _LABELS.items()]
    texts += [F.when(F.col("n_complete") == 0, F.lit("empty: no complete row")), F.when((F.col("n_complete") > 0) & (F.col("n_complete") < min_rows), F.lit(f"fewer than {min_rows} rows"))]
    out = found.withColumn("problems", F.filter(F.array(*texts), lambda x: x.isNotNull()))
    return out.withColumn("valid", F.size("problems") == 0)


def validate_ohlcv(raw: DataFrame, min_rows: int = 2, allow_zero_volume: bool = True, strict: bool = True) -> DataFrame:
    """Complete rows of valid tickers.

    ``strict`` raises on the first ticker with a violation; otherwise such
    tickers are left out, and ``violations`` tells why.
    """
    bars = coerce_bars(raw)
    found = with_verdict(violations(bars, allow_zero_volume), min_rows)
    if strict:
        rows = found.where("not valid").orderBy("ticker").limit(1).collect()
        if rows:
            row = rows[0]
            if list(row["problems"]) == [f"fewer than {min_rows} rows"]:
                raise InsufficientDataError(f"{row['ticker']} has too few rows", required=min_rows, available=row["n_complete"])
            raise SchemaError(f"{row['ticker']} breaks the rules of bars.", list(row["problems"]))
        if bars.limit(1).count() == 0:
            raise SchemaError("the table of bars is empty")
    good = bars.dropna(subset=list(PRICES))
    return good.join(found.where("valid").select("ticker"), "ticker", "left_semi")


def detect_gaps(bars: DataFrame, max_holiday_run: int = MAX_HOLIDAY_RUN) -> DataFrame:
    """``(ticker, gap_start, gap_end, n_days)``: runs of missing weekdays longer than allowed.

    Runs are counted on the grid of weekdays between a ticker's first and last
    session, so a session on a weekend neither splits nor ends one.
    """
    span = bars.groupBy("ticker").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    days = span.select("ticker", F.explode(F.sequence("lo", "hi")).alias("date")).where(F.weekday("date") < 5)
    by_day = Window.partitionBy("ticker").orderBy("date")
    days = days.withColumn("k", F.row_number().over(by_day))
    missing = days.join(bars.select("ticker", "date").distinct(), ["ticker", "date"], "left_anti")
    runs = missing.withColumn("run", F.col("k") - F.row_number().over(by_day))
    out = runs.groupBy("ticker", "run").agg(F.min("date").alias("gap_start"), F.max("date").alias("gap_end"), F.count(F.lit(1)).alias("n_days"))
    return out.where(F.col("n_days") > max_holiday_run).drop("run")


def describe_gaps(gaps: DataFrame) -> DataFrame:
    """``(ticker, description)`` of the tickers that have gaps: their number and the longest, as text."""
    longest = F.max_by(F.struct("gap_start", "gap_end", "n_days"), F.struct("n_days", "gap_start"))
    out = gaps.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), longest.alias("g"))
    text = F.format_string("%d gap(s), the longest of %d weekdays from %s to %s", "n", "g.n_days", F.col("g.gap_start").cast("string"), F.col("g.gap_end").cast("string"))
    return out.select("ticker", text.alias("description"))
