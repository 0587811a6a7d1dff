"""WARC archives: writing, reading back, and a merged capture index.

An archive is a row of bytes: a warcinfo record and then records up to a bound
of bytes, each a gzip member of its own, so that a record can be read from its
offset alone.  Spark's text writer puts one row into each file through its
commit protocol, on any file system it knows, so archives survive lost
executors.  A payload that another record holds already becomes a revisit
record, which refers to that record and repeats no payload.

Reading parses archives member by member and sorts each archive's captures by
URL key, time and record.  A task merges the runs of its archives into longer
ones, up to a bound of captures, and these are written to the shared folder.
They are merged externally: captures are dealt by ranges of the whole order, so
many that a range has a bounded number of them at any size and however often a
key occurs, and a task merges its range of every run with loser trees.  No tree
has more than ``fan_in`` runs open: where a range meets more, as many at a time
become one, in passes, until so many are left.  Ranges follow each other, so the
whole index is in order.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from itertools import batched, pairwise
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, materialize, new_shared_path

_END = "\r\n"
_ID = "urn:capture:"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class WarcConfig:
    """least_payload: bytes from which equal payloads are written once.
    archive_bytes: compressed bytes after which an archive is closed; a record
    is never cut.  salts: parts into which the copies of one payload are dealt.
    merge_rows: captures of a range that one task merges, on average, and those
    from which a task closes a run.  fan_in: runs that a merge has open.
    crawl_start: time of the first capture; a page is captured as many seconds
    later as its id says, modulo a year.
    """

    least_payload: int = 0
    archive_bytes: int = 8 << 20
    salts: int = 32
    merge_rows: int = 100_000
    fan_in: int = 64
    crawl_start: datetime = datetime(2024, 1, 1, tzinfo=UTC)


DEFAULT = WarcConfig()


def url_key(url: str | None) -> str:
    """Host labels in reverse, then path and query, in lower case: ``com,example)/a?b=1``.

    A leading ``www`` label and default ports are left out.
    """
    try:
        parts = urlsplit((url or "").strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return (url or "").strip().lower()
    labels = host.lower().split(".")
    if len(labels) > 1 and re.fullmatch(r"www\d*", labels[0]):
        labels = labels[1:]
    key = ",".join(reversed(labels))
    if port and (parts.scheme, port) not in (("http", 80), ("https", 443)):
        key += f":{port}"
    return f"{key}){(parts.path or '/').lower()}" + (f"?{parts.query.lower()}" if parts.query else "")


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _one_line(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f\x85  ]+", " ", value).strip()


def record_bytes(page_id: int | None, url: str | None, html: str | None, size: int, digest: str, response: int | None, revisit: bool, cfg: WarcConfig) -> bytes:
    """A whole record.  A revisit states the size of the payload that it does not repeat."""
    block = _HTTP.format(size).encode() + (b"" if revisit else (html or "").encode("utf-8"))
    when = cfg.crawl_start + timedelta(seconds=(page_id or 0) % 31_536_000)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>",
        f"WARC-Date: {when:%Y-%m-%dT%H:%M:%SZ}",
        f"WARC-Target-URI: {_one_line(url or '')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{_ID}{'' if response is None else response}>"]
    return (_END.join(head) + _END + _END).encode("utf-8") + block + 2 * _END.encode()


def _info_record(cfg: WarcConfig) -> bytes:
    block = f"software: varsight{_END}format: WARC File Format 1.1{_END}".encode()
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <{_ID}info>", f"WARC-Date: {cfg.crawl_start:%Y-%m-%dT%H:%M:%SZ}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return (_END.join(head) + _END + _END).encode() + block + 2 * _END.encode()


def _member(record: bytes) -> bytes:
    """A gzip member.  It ends with the upper byte of the record's length, and an
    empty member follows where that byte is not zero, as for 16 MB and more.
    """
    packed = gzip.compress(record, 5, mtime=0)
    return packed if packed.endswith(b"\0") else packed + gzip.compress(b"", mtime=0)


def _without_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows without the payloads that are copies for certain, as a smaller id in the batch has the same one."""
    for batch in batches:
        names = batch.schema.names
        ids, digests = batch.column(names.index("page_id")).to_pylist(), batch.column(names.index("digest")).to_pylist()
        least: dict[str, int] = {}
        for i, d in zip(ids, digests, strict=True):
            if d is not None and i is not None and i < least.get(d, i + 1):
                least[d] = i
        copy = pa.array([d is not None and d in least and i != least[d] for i, d in zip(ids, digests, strict=True)])
        at = names.index("html")
        html = pc.if_else(copy, pa.scalar(None, batch.column(at).type), batch.column(at))
        yield pa.RecordBatch.from_arrays([html if k == at else batch.column(k) for k in range(len(names))], names)


def _write_rows(cfg: WarcConfig) -> Callable:
    """Rows to archives, each without its last byte, which is zero and which the writer adds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = _member(_info_record(cfg))
        held: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join([info, *held])[:-1]], pa.binary())], ["value"])

        for batch in batches:
            names = ("page_id", "url", "html", "size", "sha1", "first_id", "copies")
            for page_id, url, html, n, sha1, first, copies in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                bare = base64.b32encode(bytes.fromhex(sha1)).decode()
                revisit = bool(copies and copies > 1 and first is not None and page_id != first)
                held.append(_member(record_bytes(page_id, url, html, n, bare, first, revisit, cfg)))
                size += len(held[-1])
                if size >= cfg.archive_bytes:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    return run


def write_archives(pages: DataFrame, path: str, cfg: WarcConfig = DEFAULT) -> None:
    """Write a record per row of ``pages(page_id, url, html)`` into archives under ``path``.

    The files are gzipped WARC; their names are those of Spark's text writer.

    Of rows with equal payloads of ``least_payload`` bytes or more, that with
    the smallest page_id is the response; rows that repeat its id are responses
    as well, rows without an id are revisits.  A null html is an empty payload.

    Copies of a payload are dealt to ``salts`` parts, and lose their html before
    the shuffle where a task sees that they are copies.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("size", F.octet_length("html").cast("long")).withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    rows = rows.withColumn("digest", F.when(F.col("size") >= cfg.least_payload, F.col("sha1")))
    firsts = rows.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("digest is not null and copies > 1")
    firsts = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(cfg.salts - 1)))).hint("merge")
    shed = rows.transform(map_arrow, _without_copies, "page_id long, url string, html string, size long, sha1 string, digest string").withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(cfg.salts)).cast("int"))
    joined = shed.join(firsts, ["digest", "salt"], "left").select("page_id", "url", "html", "size", "sha1", "first_id", "copies")
    archives = joined.transform(map_arrow, _write_rows(cfg), "value binary").select(F.col("value").cast("string").alias("value"))
    archives.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], int, bytes]]:
    """Header fields in lower case, offset of the gzip member and block of every record of an archive."""
    view, at, start, step = memoryview(data), 0, 0, 1 << 16
    while start < len(data):
        unzip = zlib.decompressobj(wbits=31)
        parts, at = [], start
        while not unzip.eof:
            if at >= len(data):
                raise ValueError(f"the member at byte {start} is cut off")
            parts.append(unzip.decompress(view[at : at + step]))
            at = min(at + step, len(data))
        record = b"".join(parts)
        if record:
            end = record.find(b"\r\n\r\n")
            if end < 0 or not record.startswith(b"WARC/"):
                raise ValueError(f"no record at byte {start}")
            fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in record[:end].decode("utf-8").split(_END)[1:])
            head = {k.lower(): v for k, v in fields.items()}
            size = int(head["content-length"])
            if len(record) != end + 4 + size + 4:
                raise ValueError(f"the record at byte {start} does not have the length it states")
            yield head, start, record[end + 4 : end + 4 + size]
        start = at - len(unzip.unused_data)


_CAPTURE = "url_key string, captured string, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, archive string, record_offset long"
_NAMES = [c.split()[0] for c in _CAPTURE.split(", ")]


def _number(value: str) -> int | None:
    digits = value.strip("<>").removeprefix(_ID)
    return int(digits) if digits else None


def _archive_run(path: str, content: bytes) -> list[tuple]:
    """The captures of an archive in order; payloads are checked by digest."""
    run = []
    for head, at, block in parse_records(content):
        kind = head["warc-type"]
        if kind == "warcinfo":
            continue
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(re.search(rb"(?im)^content-length: *(\d+)", http)[1])
        digest = head["warc-payload-digest"].removeprefix("sha1:")
        if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
            raise ValueError(f"{path} at {at}: the payload does not match its digest")
        refers = _number(head["warc-refers-to"]) if kind == "revisit" else None
        run.append((url_key(head["warc-target-uri"]), head["warc-date"], _number(head["warc-record-id"]), kind, refers, size, digest, path, at))
    return sorted(run, key=_order)


def _captures(cfg: WarcConfig) -> Callable:
    """Archives ``path, content`` to runs of captures, each in order and named after its first archive."""

    def merged(runs: list[list[tuple]]) -> Iterator[pa.RecordBatch]:
        name = min(r[0][7] for r in runs)
        for batch in _in_batches(merge_runs(runs, cfg.fan_in)):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([name] * batch.num_rows, pa.string())], [*_NAMES, "run"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: list[list[tuple]] = []
        rows = 0
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                found = _archive_run(path, content)
                if found:
                    runs.append(found)
                    rows += len(found)
                if rows >= cfg.merge_rows:
                    yield from merged(runs)
                    runs, rows = [], 0
        if runs:
            yield from merged(runs)

    return run


_TYPES = [pa.int64() if " long" in c else pa.string() for c in _CAPTURE.split(", ")]


def _order(row: tuple) -> tuple:
    return (row[0], row[1], -1 if row[2] is None else row[2], row[7], row[8])


class LoserTree:
    """Merge of k sorted runs: each inner node keeps the loser of its match."""

    def __init__(self, runs: list[list[tuple]], key: Callable = _order):
        self.runs = [r for r in runs if r]
        self.key = key
        self.at = [0] * len(self.runs)
        k = len(self.runs)
        self.heads = [key(r[0]) for r in self.runs]
        self.tree = [-1] * max(k, 1)
        self.winner = -1
        for run in range(k):
            self._settle(run)

    def _beats(self, a: int, b: int) -> bool:
        """Whether run a's head comes before run b's; an empty slot loses last, while filling wins."""
        if self.heads[a] is None or self.heads[b] is None:
            return self.heads[b] is None and (self.heads[a] is not None or a < b)
        return (self.heads[a], a) < (self.heads[b], b)

    def _settle(self, run: int) -> None:
        node = (run + len(self.runs)) // 2
        while node > 0:
            other = self.tree[node]
            if other < 0:
                self.tree[node] = run
                return
            if self._beats(other, run):
                self.tree[node], run = run, other
            node //= 2
        self.winner = run

    def __iter__(self) -> Iterator[tuple]:
        while self.runs and self.heads[self.winner] is not None:
            run = self.winner
            yield self.runs[run][self.at[run]]
            self.at[run] += 1
            rest = self.runs[run]
            self.heads[run] = self.key(rest[self.at[run]]) if self.at[run] < len(rest) else None
            self._settle(run)


def merge_runs(runs: list[list[tuple]], fan_in: int, key: Callable = _order) -> LoserTree:
    """Sorted runs as one sorted stream, with at most ``fan_in`` of them open in any tree."""
    while len(runs) > fan_in:
        runs = [list(LoserTree(runs[k : k + fan_in], key)) for k in range(0, len(runs), fan_in)]
    return LoserTree(runs, key)


def _in_batches(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    for some in batched(rows, 8192):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), _TYPES, strict=True)], _NAMES)


def _merge(cfg: WarcConfig) -> Callable:
    """A task's share of every run, each in order, to one sorted stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[str, list[tuple]] = {}
        for batch in batches:
            for *row, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                runs.setdefault(name, []).append(tuple(row))
        for rows in runs.values():
            # a range's share of a run comes in order, if its blocks did
            if any(_order(a) > _order(b) for a, b in pairwise(rows)):
                rows.sort(key=_order)
        yield from _in_batches(merge_runs(list(runs.values()), cfg.fan_in))

    return run


def read_captures(spark: SparkSession, path: str, cfg: WarcConfig = DEFAULT) -> DataFrame:
    """The index of the archives under ``path``: captures by URL key, time and record id.

    Partitions are consecutive ranges of that order, and each is sorted.  The
    archive and the offset end the order, so that no two captures are equal in it.
    """
    archives = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") > 0).select("path", "content")
    runs = materialize(archives.transform(map_arrow, _captures(cfg), f"{_CAPTURE}, run string"), "runs")
    ranges = max(1, -(-runs.count() // cfg.merge_rows))
    order = ["url_key", "captured", F.coalesce("page_id", F.lit(-1)), "archive", "record_offset"]
    return runs.repartitionByRange(ranges, *order).transform(map_arrow, _merge(cfg), _CAPTURE)


def archive_pages(pages: DataFrame, cfg: WarcConfig = DEFAULT) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and return the index read back."""
    spark = pages.sparkSession
    path = new_shared_path(spark, "warc")
    write_archives(pages, path, cfg)
    return read_captures(spark, path, cfg)
