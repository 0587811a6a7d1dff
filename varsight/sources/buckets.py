"""Bars laid out for what reads them: buckets by ticker, sorted by date.

Every operator starts by bringing a ticker's sessions together in order.  A table
in buckets has them so on disk: its scan says that rows are dealt by ticker, and
frames, the as-of step and the curves need no exchange of the bars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SourceError


#: The stored name of the ticker.  It is renamed when it is read: Spark knows the partitioning of a union of
#: two sides only where columns do not carry their table's name.
_KEY = "symbol"


def write_buckets(bars: DataFrame, table: str, buckets: int) -> None:
    """Replace ``table`` of the session's catalog by bars in so many buckets, a file for each."""
    if buckets < 1:
        raise ValueError("buckets must be >= 1")
    dealt = bars.withColumnRenamed("ticker", _KEY).repartition(buckets, _KEY)
    dealt.write.mode("overwrite").format("parquet").bucketBy(buckets, _KEY).sortBy(_KEY, "date").saveAsTable(table)


def bucket_count(spark: SparkSession, table: str) -> int:
    """How many buckets by ticker a table has."""
    facts = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where(F.col("col_name").isin("Num Buckets", "Bucket Columns")).collect()}
    if facts.get("Bucket Columns") not in (f"[`{_KEY}`]", f"[{_KEY}]"):
        raise SourceError(f"{table} is not in buckets by ticker")
    return int(facts["Num Buckets"])


def read_buckets(spark: SparkSession, table: str) -> tuple[DataFrame, int]:
    """Bars of a table in buckets, and the number of buckets for ``decompose_events``."""
    return spark.table(table).withColumnRenamed(_KEY, "ticker"), bucket_count(spark, table)
