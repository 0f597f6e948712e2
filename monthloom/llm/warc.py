"""Operator 6: web archives under a two-level capture index.

Writing. Every page becomes one gzip member of a WARC/1.1 file. Of equal payloads (same SHA-1 and
length) of at least ``min_bytes`` bytes, the page with the largest id is stored as response; the
others are revisit records that name it and hold no payload.

Index. Captures are range-partitioned by reversed-host URL key and page id, so that one key with
very many captures spreads over parts. Each part is one file of compressed blocks of sorted capture
lines, with a sparse directory (first key and byte range of every block) behind them.

Look-up. The first keys of the parts, one string per ``CAPTURES_PER_PART`` captures or more, route
an asked URL to its part or parts. There a binary search in the directory finds the blocks, which
are range-read, unpacked once and searched by bisection; then the record itself is range-read.

Null payloads count as empty, a null or blank URL as ``urn:page:<id>``. Rows that share the largest
page id of a payload are all responses; a null page id is a response only where no page of that
payload has an id. Repeated rows are repeated captures. An empty table gives no files and no rows.
File names are unique to a task attempt and only finished tasks' rows name them.
"""
from __future__ import annotations

import base64
import hashlib
import json
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from monthloom.llm.files import TaskFile, open_file, scan_partitions, shared_folder
from monthloom.shipping import ship_package
from monthloom.staging import stage

BLOCK_LINES = 3_000
CAPTURES_PER_PART = 250_000
_FILE_BYTES = 1 << 30
_ROWS = 200
#: Fixed values of the public archive format.
_VERSION = b"WARC/1.1"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PORTS = {"http": 80, "https": 443}
_SEPARATOR = "\t"


def url_key(url: str) -> str:
    """Reversed-host key of a URL: ``http://www.Example.com:80/a?b#c`` is ``com,example,www)/a?b``."""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname, parts.port
    except ValueError:
        return quote(url.strip(), safe="%/:=&?~#+!$,;'@()*[]")
    if not host:
        return quote(url.strip(), safe="%/:=&?~#+!$,;'@()*[]")
    place = ",".join(reversed(host.rstrip(".").split(".")))
    if port and port != _PORTS.get(parts.scheme.lower()):
        place += f":{port}"
    rest = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return f"{place}){quote(rest, safe='%/:=&?~#+!$,;@()*[]')}"


def _zip(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def page_urn(page_id: int | None) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def urn_page(urn: str) -> int | None:
    number = urn.strip("<>").removeprefix("urn:page:")
    return int(number) if number else None


def record(page_id: int | None, url: str, payload: bytes, date: str, refers: bool,
           refers_to: int | None, digest: str) -> bytes:
    """One record; a revisit keeps the HTTP head, whose length is that of the full payload."""
    block = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
             f"Content-Length: {len(payload)}\r\n\r\n").encode()
    head = [_VERSION.decode(), f"WARC-Type: {'revisit' if refers else 'response'}",
            f"WARC-Record-ID: <{page_urn(page_id)}>", f"WARC-Target-URI: {url}",
            f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}",
            "Content-Type: application/http; msgtype=response"]
    if refers:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{page_urn(refers_to)}>"]
    else:
        block += payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Record head, HTTP head (lower-case names) and payload."""
    top, _, rest = data.partition(b"\r\n\r\n")
    lines = top.decode().split("\r\n")
    if lines[0].encode() != _VERSION:
        raise ValueError("not a record of the expected version")
    head = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(head["Content-Length"])]
    inner, _, payload = block.partition(b"\r\n\r\n")
    http = dict(line.lower().split(": ", 1) for line in inner.decode().split("\r\n")[1:])
    return head, http, payload


# --- writing -----------------------------------------------------------------------------------

def _clean_url(url: str | None, page_id: int | None) -> str:
    url = "".join(url.split()) if url else ""
    return url or page_urn(page_id)


def _digest(payload: Column) -> Column:
    return F.unhex(F.sha1(F.coalesce(payload, F.lit("")).cast("binary")))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, key: str = "page_id",
                   url: str = "url", payload: str = "html", date: str | None = None) -> DataFrame:
    """Write the archives; returns the staged captures ``url_key, page_id, file, offset, length``."""
    ship_package(pages.sparkSession)
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    source = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"),
                          F.coalesce(F.col(payload), F.lit("")).alias("body"))
    digests = source.select("page_id", _digest(F.col("body")).alias("digest"),
                            F.octet_length("body").alias("bytes"))
    repeated = stage(
        digests.filter(F.col("bytes") >= min_bytes).groupBy("digest", "bytes")
        .agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).filter("n > 1")
        .select("digest", "bytes", "keeper"), "warc-repeats")
    # The staged side is broadcast only below Spark's own limit; else AQE splits a hot payload.
    joined = (
        source.withColumns({"digest": _digest(F.col("body")), "bytes": F.octet_length("body")})
        .join(repeated, ["digest", "bytes"], "left")
        .select("page_id", "url", "body", "keeper",
                (F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper")))
                .alias("refers")))
    schema = pa.schema([("url_key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()),
                        ("offset", pa.int64()), ("length", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        out: TaskFile | None = None
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                rows = []
                for page, address, body, keeper, refers in zip(
                        *(c.to_pylist() for c in batch.slice(at, _ROWS).columns)):
                    if out is None:
                        out = TaskFile(folder, f"archive-{task:06d}", ".warc.gz")
                    data = body.encode("utf-8", "surrogatepass")
                    target = _clean_url(address, page)
                    member = _zip(record(page, target, data, date, refers, keeper,
                                         base32_sha1(data)))
                    rows.append((url_key(target), page, out.name, out.write(member),
                                 len(member)))
                    if out.size >= _FILE_BYTES:
                        out.close()
                        out = None
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)],
                    schema=schema)
        if out is not None:
            out.close()

    return stage(joined.mapInArrow(
        run, "url_key string, page_id long, file string, offset long, length long"),
        "warc-captures")


# --- index -------------------------------------------------------------------------------------

def build_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES,
                per_part: int = CAPTURES_PER_PART) -> DataFrame:
    """Write the index parts; returns the staged list ``first_key, file, directory, size`` of
    parts, in which ``directory`` and ``size`` are the byte range of the part's block directory."""
    parts = max(1, -(-captures.count() // per_part))
    ordered = (captures.repartitionByRange(parts, "url_key", "page_id", "file", "offset")
               .sortWithinPartitions("url_key", "page_id", "file", "offset"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: TaskFile | None = None
        directory: list[tuple[str, int, int]] = []
        lines: list[str] = []
        first = ""

        def flush() -> None:
            if lines:
                member = _zip("".join(lines).encode())
                directory.append((first, out.write(member), len(member)))
                lines.clear()

        for batch in batches:
            for key, *where in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    task = TaskContext.get().partitionId()
                    out = TaskFile(folder, f"index-{task:06d}", ".cdx.gz")
                if not lines:
                    first = key
                lines.append(f"{key}{_SEPARATOR}{json.dumps(where)}\n")
                if len(lines) == block_lines:
                    flush()
        if out is None:
            return
        flush()
        data = _zip(json.dumps(directory).encode())
        at = out.write(data)
        out.close()
        yield pa.RecordBatch.from_pydict({
            "first_key": [directory[0][0]], "file": [out.name], "directory": [at],
            "size": [len(data)]})

    built = ordered.select("url_key", "page_id", "file", "offset", "length").mapInArrow(
        run, "first_key string, file string, directory long, size long")
    return stage(built, "warc-index")


class _Part:
    """One index part: its directory, and the block that was read last."""

    def __init__(self, folder: str, file: str, directory: int, size: int):
        self.source = open_file(folder, file)
        self.blocks = json.loads(zlib.decompress(self.source.read_at(size, directory), 31))
        self.first = [b[0] for b in self.blocks]
        self.held: tuple[int, list[str], list[str]] = (-1, [], [])

    def _block(self, i: int) -> tuple[list[str], list[str]]:
        if self.held[0] != i:
            _, at, size = self.blocks[i]
            lines = zlib.decompress(self.source.read_at(size, at), 31).decode().splitlines()
            self.held = (i, [x.partition(_SEPARATOR)[0] for x in lines], lines)
        return self.held[1], self.held[2]

    def find(self, key: str) -> Iterator[list]:
        i = max(0, bisect_left(self.first, key) - 1)
        while i < len(self.blocks) and self.first[i] <= key:
            keys, lines = self._block(i)
            for line in lines[bisect_left(keys, key): bisect_right(keys, key)]:
                yield json.loads(line.partition(_SEPARATOR)[2])
            i += 1

    def close(self) -> None:
        self.source.close()


class Archive:
    """Archives and their index in one shared folder."""

    def __init__(self, spark: SparkSession, pages: DataFrame, min_bytes: int = 0,
                 block_lines: int = BLOCK_LINES, per_part: int = CAPTURES_PER_PART, **columns):
        self.spark, self.tasks = spark, scan_partitions(pages)
        self.folder = shared_folder(spark, "warc")
        self.captures = write_archives(pages, self.folder, min_bytes, **columns)
        self.parts = build_index(self.captures, self.folder, block_lines, per_part)
        # One short row per CAPTURES_PER_PART captures: the top of the index.
        self.top = sorted(tuple(r) for r in self.parts.collect())

    def look_up(self, urls: DataFrame, url: str = "url", key: str | None = None) -> DataFrame:
        """Captures of the asked URLs, each URL asked once: ``url_key, page_id, file, offset,
        length``. A blank URL is asked by the page id in column ``key``."""
        top, folder = self.top, self.folder
        first = [t[0] for t in top]
        ident = F.col(key).cast("long") if key else F.lit(None).cast("long")
        asked = urls.select(F.col(url).alias("url"),
                            F.when(F.trim(F.coalesce(F.col(url), F.lit(""))) == "", ident)
                            .alias("page")).distinct()

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys, parts = [], []
                for address, page in zip(*(c.to_pylist() for c in batch.columns)):
                    k = url_key(_clean_url(address, page))
                    low = max(0, bisect_left(first, k) - 1)
                    for p in range(low, bisect_right(first, k)):
                        keys.append(k)
                        parts.append(p)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.string()), pa.array(parts, pa.int32())],
                    names=["url_key", "part"])

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number, part = -1, None
            for batch in batches:
                rows = []
                for k, p in zip(*(c.to_pylist() for c in batch.columns)):
                    if p != number:
                        if part is not None:
                            part.close()
                        number, part = p, _Part(folder, *top[p][1:])
                    rows += [(k, *found) for found in part.find(k)]
                    if len(rows) >= 10_000:
                        yield _captures(rows)
                        rows = []
                if rows:
                    yield _captures(rows)
            if part is not None:
                part.close()

        routed = asked.mapInArrow(route, "url_key string, part int").distinct()
        return (routed.repartitionByRange(self.tasks, "part", "url_key")
                .sortWithinPartitions("part", "url_key")
                .mapInArrow(search, "url_key string, page_id long, file string, offset long, "
                                    "length long"))

    def read(self, captures: DataFrame, with_payload: bool = True) -> DataFrame:
        """Records at the given byte ranges: ``page_id, url, record_type, refers_to,
        payload_bytes, payload_digest`` and, on request, ``payload`` (null for revisits)."""
        folder = self.folder

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            name, source = None, None
            for batch in batches:
                rows = []
                for file, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                    if file != name:
                        if source is not None:
                            source.close()
                        name, source = file, open_file(folder, file)
                    head, http, payload = parse_record(
                        zlib.decompress(source.read_at(length, offset), 31))
                    refers = head["WARC-Type"] == "revisit"
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if not refers and base32_sha1(payload) != digest:
                        raise ValueError(f"{file} at {offset}: the payload is damaged")
                    row = (urn_page(head["WARC-Record-ID"]), head["WARC-Target-URI"],
                           head["WARC-Type"],
                           urn_page(head["WARC-Refers-To"]) if refers else None,
                           int(http["content-length"]) if refers else len(payload), digest)
                    rows.append((*row, None if refers else payload) if with_payload else row)
                    if len(rows) >= _ROWS:
                        yield _records(rows, with_payload)
                        rows = []
                if rows:
                    yield _records(rows, with_payload)
            if source is not None:
                source.close()

        ddl = ("page_id long, url string, record_type string, refers_to long, "
               "payload_bytes long, payload_digest string")
        return (captures.select("file", "offset", "length")
                .repartitionByRange(self.tasks, "file", "offset")
                .sortWithinPartitions("file", "offset")
                .mapInArrow(run, ddl + (", payload binary" if with_payload else "")))


def _captures(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"url_key": pa.string(), "page_id": pa.int64(), "file": pa.string(),
             "offset": pa.int64(), "length": pa.int64()}
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())],
        names=list(kinds))


def _records(rows: list[tuple], with_payload: bool) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(),
             "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string()}
    if with_payload:
        kinds["payload"] = pa.binary()
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())],
        names=list(kinds))
