"""Readers: price and event files, ticker lists, and bars built from trades."""

from __future__ import annotations

from datetime import date, timedelta
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InsufficientDataError, MissingEventsError, SchemaError, SourceError
from ..operators.quality import detect_gaps, validate_ohlcv

BARS = T.StructType([T.StructField("ticker", T.StringType()), T.StructField("date", T.DateType()), *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")]])
EVENT_COLUMNS = ("earnings_date", "date", "announcement_date")
TICKER_COLUMNS = ("ticker", "symbol", "tickers")


class PriceSource(Protocol):
    """Anything that gives raw bars: a table, a file, a provider's client; ``recorded.RecordedPrices`` is one as a Spark data source."""

    def bars(self, spark: SparkSession) -> DataFrame: ...


def default_range(years: float = 7, end: date | None = None) -> tuple[date, date]:
    end = end or date.today()
    return end - timedelta(days=round(years * 365.25)), end


def _lower_header(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower() for c in df.columns])


def read_price_csv(spark: SparkSession, path: str, ticker: str | None = None) -> DataFrame:
    """Raw bars of a CSV file with a header; ``ticker`` names those without such a column."""
    df = _lower_header(spark.read.option("header", True).csv(path))
    if "ticker" not in df.columns:
        if ticker is None:
            raise SchemaError("prices have no ticker column and no ticker was named", ["missing 'ticker'"])
        df = df.withColumn("ticker", F.lit(ticker))
    elif ticker is not None:
        df = df.where(F.upper(F.trim("ticker")) == ticker.upper())
    return df


def read_price_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def load_prices(
    raw: DataFrame,
    tickers: list[str] | None = None,
    start: date | None = None,
    end: date | None = None,
    min_rows: int = 60,
    raise_on_gaps: bool = False,
    strict: bool = True,
) -> DataFrame:
    """Validated bars of the tickers within the dates, both ends included.

    Filters come first, so they reach the scan of a Parquet source.
    """
    df = raw
    if tickers is not None:
        df = df.where(F.col("ticker").isin([t.strip().upper() for t in tickers]))
    if start is not None:
        df = df.where(F.col("date") >= F.lit(start))
    if end is not None:
        df = df.where(F.col("date") <= F.lit(end))
    if strict and df.limit(1).count() == 0:
        raise SourceError("the source has no bars for these tickers and dates")
    bars = validate_ohlcv(df, strict=strict)
    counts = bars.groupBy("ticker").count().where(F.col("count") < min_rows)
    if strict:
        short = counts.first()
        if short is not None:
            raise InsufficientDataError(f"{short['ticker']} has too few sessions", required=min_rows, available=short["count"])
    else:
        bars = bars.join(counts.select("ticker"), "ticker", "left_anti")
    if raise_on_gaps:
        gap = detect_gaps(bars).first()
        if gap is not None:
            raise SchemaError("there are gaps between sessions.", [f"{gap['ticker']}: {gap['n_days']} weekdays from {gap['gap_start']}"])
    return bars


def _pick(columns: list[str], names: tuple[str, ...]) -> str:
    plain = {c.strip().lower(): c for c in columns}
    return next((plain[n] for n in names if n in plain), columns[0])


def _as_date(c: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(c), F.try_to_timestamp(c, F.lit("MM/dd/yyyy"))).cast("date")


def read_event_csv(spark: SparkSession, path: str, ticker: str | None = None, column: str | None = None) -> DataFrame:
    """Distinct ``(ticker, announcement_date)`` of a CSV file; what is no date is dropped."""
    df = spark.read.option("header", True).csv(path)
    if column is not None and column not in df.columns:
        raise SchemaError("the event file lacks its column.", [f"missing '{column}'"])
    picked = column or _pick(df.columns, EVENT_COLUMNS)
    named = next((c for c in df.columns if c.strip().lower() == "ticker"), None)
    who = F.lit(ticker) if named is None else F.upper(F.trim(F.col(named)))
    out = df.select(who.alias("ticker"), _as_date(F.trim(F.col(f"`{picked}`"))).alias("announcement_date")).dropna(subset=["announcement_date"]).distinct()
    if out.limit(1).count() == 0:
        raise MissingEventsError(f"{path} holds no event date")
    return out


def load_events(events: DataFrame, asof: date | None = None, include_future: bool = False, limit: int | None = None) -> DataFrame:
    """Distinct event dates, by default those before ``asof``; at most ``limit`` latest by ticker.

    Stamps, as text with a zone or as timestamps, count by their day in UTC.
    """
    when = F.col("announcement_date")
    kind = events.schema["announcement_date"].dataType
    if isinstance(kind, T.StringType):
        when = F.coalesce(F.try_to_timestamp(when), F.try_to_timestamp(when, F.lit("yyyy-MM-dd HH:mm:ssXXX")))
    if isinstance(kind, T.StringType | T.TimestampType):
        when = F.to_utc_timestamp(when, F.current_timezone())
    df = events.select("ticker", F.to_date(when).alias("announcement_date")).dropna().distinct()
    if not include_future:
        df = df.where(F.col("announcement_date") < (F.lit(asof) if asof else F.current_date()))
    if limit is not None:
        latest = Window.partitionBy("ticker").orderBy(F.desc("announcement_date"))
        df = df.withColumn("_k", F.row_number().over(latest)).where(F.col("_k") <= limit).drop("_k")
    return df


def read_universe(spark: SparkSession, path: str) -> list[str]:
    """Tickers of a CSV file in their order, upper case and without repeats.

    The list configures a run, so it is small and comes to the driver.
    """
    df = spark.read.option("header", True).csv(path)
    c = _pick(df.columns, TICKER_COLUMNS)
    rows = df.select(F.upper(F.trim(F.col(f"`{c}`"))).alias("ticker"), F.monotonically_increasing_id().alias("k"))
    first = rows.where("ticker is not null and ticker != ''").groupBy("ticker").agg(F.min("k").alias("k")).orderBy("k")
    return [r["ticker"] for r in first.collect()]


def trade_bars(trades: DataFrame, order: list[str]) -> DataFrame:
    """Daily bars of trades ``(ticker, date, price, size, *order)``.

    Open and close are the prices of the first and last trade in the order of
    the given columns, then of the price.
    """
    key = F.struct(*order, "price")
    return trades.groupBy("ticker", "date").agg(
        F.min_by("price", key).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", key).alias("close"), F.sum("size").alias("volume")
    )


def lineitem_bars(lineitem: DataFrame) -> DataFrame:
    """Bars of line items: flag and status are the ticker, unit prices the trades."""
    trades = lineitem.select(
        F.concat("l_returnflag", "l_linestatus").alias("ticker"),
        F.to_date("l_shipdate").alias("date"),
        (100 + F.col("l_extendedprice") / F.col("l_quantity") / 1000).alias("price"),
        F.col("l_quantity").cast("double").alias("size"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
    )
    return trade_bars(trades, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


def lineitem_announcements(lineitem: DataFrame) -> DataFrame:
    """The first day of every quarter in which a ticker has line items."""
    return lineitem.select(F.concat("l_returnflag", "l_linestatus").alias("ticker"), F.to_date(F.date_trunc("quarter", "l_shipdate")).alias("announcement_date")).distinct()


def quarter_starts(bars: DataFrame) -> DataFrame:
    """The first day of every quarter in which a ticker has bars: ``lineitem_announcements`` without reading the trades again."""
    return bars.select("ticker", F.to_date(F.date_trunc("quarter", "date")).alias("announcement_date")).distinct()
