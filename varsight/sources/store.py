"""A transactional store of bars or events by ticker, and result writers.

Rows go to a folder of their own for each write, a generation, which is never
changed: ``data/<kind>/generation=<id>/ticker=<ticker>``.  What a write stored,
or a removal dropped, is a line for each ticker in ``lines/<id>``.  A write takes
effect at once, when the file ``log/<version>.json`` that names it appears;
two writers cannot make the same version.  What a ticker's newest committed
line says holds.  Readers take the log as it is when they start, so a write that
is under way or has failed is not seen, and lines of other tickers stay.
"""

from __future__ import annotations

import json
import logging
import uuid
from collections.abc import Callable
from datetime import UTC, date, datetime, timedelta
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CacheError

log = logging.getLogger("varsight")
_LINES = "ticker string, kind string, generation string, start date, end date, auto_adjust boolean, rows long, fetched_at timestamp, dropped boolean"


class _Files:
    """The few calls on the store's file system that Spark's readers and writers do not make."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.fs = self.path(root).getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return sorted(f.getPath().getName() for f in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def age_hours(self, name: str) -> float:
        return (datetime.now(UTC).timestamp() * 1000 - self.fs.getFileStatus(self.path(name)).getModificationTime()) / 3_600_000

    def delete(self, name: str) -> bool:
        at = self.path(name)
        return bool(self.fs.exists(at) and self.fs.delete(at, True))

    def create_once(self, name: str, text: str) -> bool:
        """Whether this call made the file, whole: false if there is one already."""
        part = f"{name}.{uuid.uuid4().hex}.tmp"
        out = self.fs.create(self.path(part), False)
        out.write(bytearray(text.encode()))
        out.close()
        source, target = self.fs.makeQualified(self.path(part)), self.fs.makeQualified(self.path(name))
        try:
            if source.toUri().getScheme() == "file":  # renaming on a local disk would replace
                files, get = self.jvm.java.nio.file.Files, self.jvm.java.nio.file.Paths.get
                files.createLink(get(target.toUri()), get(source.toUri()))
            else:
                never = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), self.conf).rename(source, target, never)
            return True
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        finally:
            self.delete(part)


def _log(spark: SparkSession, root: str) -> list[dict]:
    """All commits in order."""
    names = [n for n in _Files(spark, root).names(f"{root}/log") if n.endswith(".json")]
    lines = spark.read.text([f"{root}/log/{n}" for n in names]).collect() if names else []
    return sorted((json.loads(r[0]) for r in lines), key=lambda c: c["version"])


def _versions(spark: SparkSession, root: str) -> list[dict]:
    """Commits in order, from the newest that holds all lines on."""
    found = _log(spark, root)
    whole = [i for i, c in enumerate(found) if c["whole"]]
    return found[whole[-1] :] if whole else found


def _commit(spark: SparkSession, root: str, commit: str, after: int | None = None, whole: bool = False) -> bool:
    """Make the lines of ``commit`` take effect: as the version after ``after``, if nobody took it, or as the next one that is free."""
    files = _Files(spark, root)
    version = after
    while True:
        if after is None:
            taken = [int(n.removesuffix(".json")) for n in files.names(f"{root}/log") if n.endswith(".json")]
            version = max([0, *taken])
        version += 1
        if files.create_once(f"{root}/log/{version:020d}.json", json.dumps({"version": version, "commit": commit, "whole": whole})):
            return True
        if after is not None:
            return False


def _live_lines(spark: SparkSession, root: str, commits: list[dict]) -> DataFrame:
    """The newest line of every ticker and kind that is not dropped."""
    lines = spark.read.option("basePath", f"{root}/lines").schema(_LINES + ", commit string").parquet(*[f"{root}/lines/commit={c['commit']}" for c in commits])
    order = spark.createDataFrame([(c["commit"], c["version"]) for c in commits], "commit string, version long")
    body = F.struct(*[c for c in lines.columns if c not in ("ticker", "kind", "commit")])
    newest = lines.join(F.broadcast(order), "commit").groupBy("ticker", "kind").agg(F.max_by(body, "version").alias("m"))
    return newest.select("ticker", "kind", "m.*").where("not dropped").drop("dropped")


def _day(df: DataFrame) -> str:
    return "date" if "date" in df.columns else "announcement_date"


def _utc(when: datetime) -> datetime:
    return when.replace(tzinfo=UTC) if when.tzinfo is None else when.astimezone(UTC)


def write_store(df: DataFrame, root: str, kind: str, auto_adjust: bool = True, fetched_at: datetime | None = None, covers: tuple[date, date] | None = None) -> None:
    """Replace the tickers' stored rows; other tickers stay.

    ``covers`` are the dates that were asked of the source; without it a line
    covers those from the first to the last row.  ``fetched_at`` is an instant;
    without a zone it is in UTC.
    """
    spark, generation = df.sparkSession, uuid.uuid4().hex
    path = f"{root}/data/{kind}/generation={generation}"
    df.write.partitionBy("ticker").parquet(path)
    written = _rows(spark, root, kind, [generation], df.schema)
    day = _day(df)
    when = F.timestamp_micros(F.lit(round(_utc(fetched_at or datetime.now(UTC)).timestamp() * 1_000_000)))
    lines = written.groupBy("ticker").agg(F.min(day).alias("start"), F.max(day).alias("end"), F.count(F.lit(1)).alias("rows"))
    if covers is not None:
        lines = lines.withColumns({"start": F.least("start", F.lit(covers[0])), "end": F.greatest("end", F.lit(covers[1]))})
    values = {"kind": F.lit(kind), "generation": F.lit(generation), "auto_adjust": F.lit(auto_adjust), "fetched_at": when, "dropped": F.lit(False)}
    _write_lines(lines.withColumns(values), root, generation)
    _commit(spark, root, generation)


def _write_lines(lines: DataFrame, root: str, commit: str) -> None:
    columns = [c.split() for c in _LINES.split(", ")]
    lines.select(*[F.col(name).cast(kind).alias(name) for name, kind in columns]).coalesce(1).write.parquet(f"{root}/lines/commit={commit}")


def _rows(spark: SparkSession, root: str, kind: str, generations: list[str], schema: T.StructType | None = None) -> DataFrame:
    """Rows of some generations, with the column ``generation``; tickers that look like numbers stay text."""
    paths = [f"{root}/data/{kind}/generation={g}" for g in generations]
    read = spark.read.option("basePath", f"{root}/data/{kind}")
    if schema is None:
        schema = read.parquet(*paths).schema
    fields = [f for f in schema if f.name not in ("ticker", "generation")]
    keys = [T.StructField("ticker", T.StringType()), T.StructField("generation", T.StringType())]
    return spark.read.option("basePath", f"{root}/data/{kind}").schema(T.StructType(fields + keys)).parquet(*paths)


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """The line that holds for every stored ticker and kind."""
    commits = _versions(spark, root)
    if not commits:
        raise CacheError(f"{root} has no manifest")
    return _live_lines(spark, root, commits)


def read_store(spark: SparkSession, root: str, kind: str, tickers: list[str] | None = None, start: date | None = None, end: date | None = None) -> DataFrame:
    """Stored rows as of now; generations and tickers prune folders and dates reach the scan."""
    lines = read_manifest(spark, root).where(F.col("kind") == kind).select("ticker", "generation")
    if tickers is not None:
        lines = lines.where(F.col("ticker").isin(tickers))
    generations = sorted(r["generation"] for r in lines.select("generation").distinct().collect())
    if not generations:
        raise CacheError(f"{root} holds no {kind} of these tickers")
    df = _rows(spark, root, kind, generations)
    if tickers is not None:
        df = df.where(F.col("ticker").isin(tickers))
    if start is not None:
        df = df.where(F.col(_day(df)) >= F.lit(start))
    if end is not None:
        df = df.where(F.col(_day(df)) <= F.lit(end))
    columns = [c for c in df.columns if c not in ("ticker", "generation")]
    return df.join(lines, ["ticker", "generation"], "left_semi").select(*columns, "ticker")


def is_fresh(line: dict, start: date, end: date, auto_adjust: bool = True, ttl_hours: float = 24, now: datetime | None = None) -> bool:
    """Whether a manifest line serves a request: it covers the dates, and either
    ended before yesterday or is younger than the time to live.  Instants without a zone are in UTC.
    """
    now = _utc(now or datetime.now(UTC))
    if line["auto_adjust"] != auto_adjust or line["start"] > start or line["end"] < end:
        return False
    settled = line["end"] < (now - timedelta(days=1)).date()
    return settled or now - _utc(line["fetched_at"]) < timedelta(hours=ttl_hours)


def _known_lines(spark: SparkSession, root: str, kind: str, tickers: list[str]) -> dict[str, dict]:
    """The tickers' lines whose folders are there, with instants in UTC."""
    try:
        lines = read_manifest(spark, root).where((F.col("kind") == kind) & F.col("ticker").isin(tickers))
    except CacheError:
        return {}
    rows = [r.asDict() for r in lines.withColumn("fetched_at", F.unix_micros("fetched_at")).collect()]
    files = _Files(spark, root)
    there = {g: set(files.names(f"{root}/data/{kind}/generation={g}")) for g in {r["generation"] for r in rows}}
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    found = {}
    for row in rows:
        if f"ticker={escape(row['ticker'])}" in there[row["generation"]]:
            found[row["ticker"]] = row | {"fetched_at": datetime.fromtimestamp(row["fetched_at"] / 1_000_000, UTC)}
    return found


def through_store(
    spark: SparkSession,
    root: str,
    kind: str,
    tickers: list[str],
    start: date,
    end: date,
    read: Callable[[], DataFrame],
    auto_adjust: bool = True,
    ttl_hours: float = 24,
    force_refresh: bool = False,
    now: datetime | None = None,
) -> DataFrame:
    """Rows of the tickers within the dates, from the store where its lines are fresh.

    Tickers that are stale, unknown, cleared or forced, and those whose folder is
    gone, are read by ``read`` and stored first; a store that cannot be written
    is passed by.  An entry covers the dates that were asked for, as a source may
    have no session on the first.
    """
    lines = _known_lines(spark, root, kind, tickers)
    stale = [t for t in tickers if force_refresh or t not in lines or not is_fresh(lines[t], start, end, auto_adjust, ttl_hours, now)]
    kept = [t for t in tickers if t not in stale]
    if stale:
        fresh = read().where(F.col("ticker").isin(stale))
        try:
            write_store(fresh, root, kind, auto_adjust, covers=(start, end))
        except Exception as e:
            log.warning("the store %s could not be written: %s", root, e)
            return fresh.unionByName(read_store(spark, root, kind, kept, start, end)) if kept else fresh
    try:
        return read_store(spark, root, kind, tickers, start, end)
    except CacheError:
        return fresh  # the source had no row


def clear_store(spark: SparkSession, root: str, ticker: str | None = None) -> int:
    """Forget a ticker's entries, or all; returns how many there were.  A missing store counts 0.

    The removal is a commit of its own, so a later request reads the source
    again, and a write that commits after it stays.  The folders are deleted
    after it; ``vacuum_store`` finds what a crash leaves.
    """
    commits = _versions(spark, root)
    if not commits:
        return 0
    lines = _live_lines(spark, root, commits)
    if ticker is not None:
        lines = lines.where(F.col("ticker") == ticker)
    commit = uuid.uuid4().hex
    _write_lines(lines.withColumn("dropped", F.lit(True)), root, commit)
    dropped = spark.read.schema(_LINES).parquet(f"{root}/lines/commit={commit}").select("ticker", "kind", "generation").collect()
    if dropped:
        _commit(spark, root, commit)
        files, escape = _Files(spark, root), spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        for row in dropped:
            files.delete(f"{root}/data/{row['kind']}/generation={row['generation']}/ticker={escape(row['ticker'])}")
    return len(dropped)


def vacuum_store(spark: SparkSession, root: str, older_than_hours: float = 168) -> int:
    """Gather all lines in one commit and delete what no line names and is older than the bound; returns how many folders went.

    A generation that a writer has not committed yet is younger than the bound.
    Where another commit comes between, the lines are gathered again.
    """
    while True:
        commits = _versions(spark, root)
        if not commits:
            return 0
        commit = uuid.uuid4().hex
        _write_lines(_live_lines(spark, root, commits).withColumn("dropped", F.lit(False)), root, commit)
        if _commit(spark, root, commit, after=commits[-1]["version"], whole=True):
            break
    files = _Files(spark, root)
    for c in commits:  # a reader may just have listed younger ones
        name = f"{root}/log/{c['version']:020d}.json"
        if files.age_hours(name) >= older_than_hours:
            files.delete(name)
    named = {c["commit"] for c in _log(spark, root)}
    live = {(r["kind"], r["generation"]) for r in read_manifest(spark, root).select("kind", "generation").distinct().collect()}
    gone = [f"{root}/lines/{n}" for n in files.names(f"{root}/lines") if n.removeprefix("commit=") not in named]
    gone += [f"{root}/data/{k}/{g}" for k in files.names(f"{root}/data") for g in files.names(f"{root}/data/{k}") if (k, g.removeprefix("generation=")) not in live]
    return sum(files.delete(n) for n in gone if files.age_hours(n) >= older_than_hours)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header in a folder per ticker."""
    df.write.mode("overwrite").option("header", True).partitionBy("ticker").csv(path)


def write_stages(status: DataFrame, path: str) -> None:
    """``(ticker, stages)`` rows as JSON lines, also for tickers that failed."""
    status.write.mode("overwrite").json(path)


def save_figure(figure, path: str, dpi: int = 150) -> Path:
    """Write a chart object by its own writer: an image, or HTML by the file's suffix."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    if hasattr(figure, "savefig"):
        figure.savefig(target, dpi=dpi, bbox_inches="tight")
    elif target.suffix.lower() in (".html", ".htm") and hasattr(figure, "write_html"):
        figure.write_html(str(target))
    elif hasattr(figure, "write_image"):
        figure.write_image(str(target))
    else:
        target.write_text(json.dumps(figure, default=str))
    return target
