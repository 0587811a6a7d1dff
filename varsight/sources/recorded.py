"""A Spark data source over recorded answers of a price provider.

A provider answers a request for one ticker and one range of dates.  Its answers
are kept as ``<path>/<ticker>/<first day>_<last day>.csv`` with the columns
``Date, Open, High, Low, Close, Volume``.  The source reads them as a provider's
client would: a partition is one ticker and one range, and filters on ticker and
date choose the partitions, and the rows of a range, before anything is read.

    spark.dataSource.register(RecordedPrices)
    spark.read.format("recorded_prices").load(path).where("ticker = 'AAA' and date >= '2024-01-01'")

Filters reach the source where ``spark.sql.python.filterPushdown.enabled`` is
set; without it Spark filters what was read.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

SCHEMA = "ticker string, date date, open double, high double, low double, close double, volume double"
_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
_DAY = dt.timedelta(days=1)


@dataclass
class RecordedRange(InputPartition):
    """One answer of the provider, and the days of it that are asked for."""

    ticker: str
    path: str
    first: dt.date
    last: dt.date

    def __post_init__(self) -> None:
        super().__init__(self.path)


@dataclass
class Request:
    """What filters leave of tickers and days; None: all."""

    tickers: set[str] | None = None
    first: dt.date = field(default=dt.date.min)
    last: dt.date = field(default=dt.date.max)

    def narrow(self, f: Filter) -> bool:
        """Whether a filter was taken up whole."""
        name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        if name == "ticker" and isinstance(f, EqualTo | EqualNullSafe | In):
            asked = {v for v in (f.value if isinstance(f, In) else [f.value]) if v is not None}
            self.tickers = asked if self.tickers is None else self.tickers & asked
            return True
        if name == "date" and isinstance(getattr(f, "value", None), dt.date):
            if isinstance(f, EqualTo | EqualNullSafe | GreaterThanOrEqual):
                self.first = max(self.first, f.value)
            if isinstance(f, EqualTo | EqualNullSafe | LessThanOrEqual):
                self.last = min(self.last, f.value)
            if isinstance(f, GreaterThan):
                self.first = dt.date.max if f.value == dt.date.max else max(self.first, f.value + _DAY)
                return f.value != dt.date.max
            if isinstance(f, LessThan):
                self.last = dt.date.min if f.value == dt.date.min else min(self.last, f.value - _DAY)
                return f.value != dt.date.min
            return isinstance(f, EqualTo | EqualNullSafe | GreaterThanOrEqual | LessThanOrEqual)
        # every row has a ticker and a date
        return name in ("ticker", "date") and isinstance(f, IsNotNull)


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class RecordedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.path = options["path"]
        self.columns = schema.fieldNames()
        self.request = Request()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if not self.request.narrow(f):
                yield f

    def partitions(self) -> list[RecordedRange]:
        """The answers that may hold rows: of the tickers asked for, with days in the range."""
        from pyarrow import fs

        files, root = _files(self.path)
        found = []
        for folder in files.get_file_info(fs.FileSelector(root, allow_not_found=False)):
            ticker = unquote(folder.base_name)
            if folder.type != fs.FileType.Directory or (self.request.tickers is not None and ticker not in self.request.tickers):
                continue
            for answer in files.get_file_info(fs.FileSelector(folder.path)):
                first, last = (dt.date.fromisoformat(x) for x in answer.base_name.removesuffix(".csv").split("_"))
                first, last = max(first, self.request.first), min(last, self.request.last)
                if first <= last:
                    found.append(RecordedRange(ticker, answer.path, first, last))
        return sorted(found, key=lambda p: (p.ticker, p.path)) or [RecordedRange("", "", dt.date.max, dt.date.min)]

    def read(self, partition: RecordedRange) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc
        from pyarrow import csv

        if not partition.path:
            return
        files, _ = _files(self.path)
        names = ["Date", "Open", "High", "Low", "Close", "Volume"]
        kinds = csv.ConvertOptions(include_columns=names, column_types={n: pa.date32() if n == "Date" else pa.float64() for n in names})
        with files.open_input_stream(partition.path) as answer, csv.open_csv(answer, convert_options=kinds) as rows:
            for batch in rows:
                day = batch.column("Date")
                batch = batch.filter(pc.and_(pc.greater_equal(day, partition.first), pc.less_equal(day, partition.last)))
                columns = {"ticker": pa.array([partition.ticker] * batch.num_rows, pa.string())} | {n.lower(): batch.column(n) for n in names}
                yield pa.RecordBatch.from_arrays([columns[c] for c in self.columns], self.columns)


class RecordedPrices(DataSource):
    """``recorded_prices``: a provider's recorded answers as bars."""

    @classmethod
    def name(cls) -> str:
        return "recorded_prices"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> RecordedReader:
        return RecordedReader(schema, self.options)


def recorded_prices(spark: SparkSession, path: str) -> DataFrame:
    """Bars of the recorded answers under ``path``; filters on ticker and date choose the answers that are read."""
    spark.dataSource.register(RecordedPrices)
    spark.conf.set(_PUSHDOWN, "true")
    return spark.read.format("recorded_prices").load(path)
