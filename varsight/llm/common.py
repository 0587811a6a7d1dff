"""Shared plumbing of the text operators: tables, shared storage, tokenizers."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

BATCH_BYTES = 8 << 20
_TRIM_THRESHOLD, _MMAP_THRESHOLD = -1, -3  # names of glibc's mallopt settings


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder of its own; a
    cluster without the setting is an error, as a machine-local folder would
    lose data with its executor.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local[") and master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def new_shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/varsight/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write to the shared folder as Parquet and read it back."""
    spark = df.sparkSession
    path = new_shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _lean(run: Callable) -> Callable:
    """``run`` in a worker that gives freed memory back, as it lives on for later tasks.

    Where the C library is glibc, large arrays are mapped on their own, so that
    they go when they are freed, and the rest is trimmed at a task's end.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        libc = ctypes.CDLL(None)
        tune, trim = getattr(libc, "mallopt", None), getattr(libc, "malloc_trim", None)
        if tune is not None and trim is not None:
            tune(_MMAP_THRESHOLD, 4 << 20)
            tune(_TRIM_THRESHOLD, 16 << 20)
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim is not None:
            trim(0)

    return wrapped


def bytes_of(size: str) -> int:
    """The number of bytes of a setting such as ``4m``, ``512 kb`` or ``1048576``."""
    found = re.fullmatch(r"(-?\d+) *([kmgtp]?)(?:i?b)?", size.strip().lower())
    if not found:
        raise ValueError(f"{size!r} is no size")
    return int(found[1]) << (10 * " kmgtp".index(found[2] or " "))


def map_arrow(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """``mapInArrow`` over batches of a bounded number of bytes, however long the texts are.

    The session's bound of a batch is lowered where it is above ``BATCH_BYTES``
    or unset, and stays so, as plans read it when they run.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < bytes_of(df.sparkSession.conf.get(key, "64m")) <= BATCH_BYTES:
        df.sparkSession.conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(_lean(run), schema)


def free_name(df: DataFrame, stem: str) -> str:
    """``stem``, or with as many underscores more as no column's name needs; case does not tell names apart."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def smallest(rows: DataFrame, k: int, mark: Column, by: str | None = None) -> DataFrame:
    """The ``k`` rows of smallest ``mark``, a 64-bit hash, of all rows or of each value of the column ``by``, which is not null.

    Equal rows count once; rows of equal marks follow by their columns.  The
    result does not depend on how rows are dealt, and no task reads the best
    rows of all others: hashes are spread evenly, so a count tells a bound below
    which about ``2 * k`` rows lie, which each task applies to its own rows.  Where
    fewer than ``k`` different rows lie below it, as repeated rows were counted too,
    it is raised.  A count and a bound for each value of ``by`` reach the driver.
    """
    spark = rows.sparkSession
    columns, into, bound = rows.columns, free_name(rows, "mark"), free_name(rows, "bound")
    marked = rows.withColumn(into, mark)

    def sizes(df: DataFrame) -> dict:
        return {r[0]: r[1] for r in df.groupBy(by).count().collect()} if by else {None: df.count()}

    share = {g: 2 * k / max(n, 1) for g, n in sizes(rows).items()}
    while True:
        below = {g: min(int(s * (1 << 64)), (1 << 64) - 1) - (1 << 63) for g, s in share.items()}
        if by:
            bounds = spark.createDataFrame(list(below.items()), StructType([StructField(by, rows.schema[by].dataType), StructField(bound, LongType())]))
            near = marked.join(bounds, by).where(F.col(into) <= F.col(bound))
        else:
            near = marked.where(F.col(into) <= F.lit(below[None]).cast("long"))
        near = materialize(near.select(*columns, into).distinct(), "sample")
        have = sizes(near)
        short = [g for g, s in share.items() if s < 1 and have.get(g, 0) < k]
        if not short:
            break
        for g in short:
            share[g] *= 8
    order = [into, *columns]
    if by is None:
        return near.orderBy(*order).limit(k).select(*columns)
    place = free_name(near, "place")
    return near.withColumn(place, F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col(place) <= k).select(*columns)


def crc_mod4(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; the held-out fold is 2."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def is_held_out(doc_id: Column) -> Column:
    """True for the held-out fold; a null id is not held out."""
    return F.coalesce(crc_mod4(doc_id) == 2, F.lit(False))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed public vocabulary file lies; the name is a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)
