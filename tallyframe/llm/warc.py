"""WARC archives with a two-level capture index.

Captures are range-partitioned and sorted by their reversed-host URL key (SURT), so a task writes
its records in key order to one archive after another, a gzip member each, and beside it an index
shard: sorted index lines in compressed blocks. What it returns is the sparse directory, one row a
block, kept as Parquet.

A search (:func:`locate`) is two joins by key order. Every task binary-searches the key ranges of the shards (one a
writing task) for each key; the keys that a shard may hold then meet that shard's part of the directory, where a binary search
finds the blocks, and another one in each decompressed block the captures. :func:`fetch` reads the byte ranges
found, neighbours in an archive at once, in as many tasks as their bytes ask for. The round trip reads all
records back this way, by the keys of the pages.

Of captures with equal payloads that with the smallest id is a response; the others are revisits
that refer to it. Payloads below ``min_bytes`` are always responses.

Archives lie in the folder that all executors share and are named by task attempt; only those whose
directory rows were committed are ever read, so a lost executor leaves nothing wrong behind.

Defined results: a null payload is an empty one; a null or malformed url has an empty or verbatim
key; a capture with a null id is a revisit of an equal one that has an id, else a response; equal ids
with equal payloads are responses alike; repeated rows are captures each; a key without captures finds none;
no rows give an empty index.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from functools import partial
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .buckets import join_hot
from .common import materialise, scratch_path

#: Index lines of a compressed block.
BLOCK_LINES = 1000
#: Bytes after which a task begins another archive.
ARCHIVE_BYTES = 1 << 30
#: Bytes of neighbouring records that are read at once, and bytes of archives that a task reads in all.
READ_BYTES, TASK_BYTES = 8 << 20, 4 << 20
#: Tasks beyond which each reads more instead.
READ_TASKS = 20_000
#: Groups of equal payloads that are broadcast (about 60 bytes each); more are joined by a shuffle.
BROADCAST_GROUPS = 100_000

DIRECTORY = "first_key string, last_key string, shard string, offset long, length long, lines long"
FOUND = "key string, id long, url string, file string, offset long, length long"
RECORD = "key string, id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def surt(url: str | None) -> str:
    """The reversed-host key of a URL: ``http://a.example.com/x?q`` becomes ``com,example,a)/x?q``."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return url
    if not host:
        return url
    port = f":{port}" if port and port != {"http": 80, "https": 443}.get(parts.scheme) else ""
    return f"{','.join(reversed(host.split('.')))}{port}){parts.path or '/'}{'?' + parts.query if parts.query else ''}"


def key_of(url: str | None) -> str:
    """The SURT in ASCII without blanks, so that it sorts alike everywhere."""
    return quote(surt(url), safe="/)(,:?&=#;+~!*'@$%[]", errors="replace")


def _header(value: str) -> str:
    return "".join(c if c.isprintable() and c != " " else quote(c) for c in value)


def record(kind: str, url: str | None, page_id: int | None, payload: bytes, digest: str, date: str, refers_to: int | None) -> bytes:
    """A WARC record; a revisit keeps the HTTP header and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {_header(url)}"] if url else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Page-ID: {page_id}"] if page_id is not None else []),
        *([f"WARC-Refers-To-Page-ID: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if kind == "revisit" else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers, HTTP header and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, http, payload


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class _Shard:
    """What one task writes: archives, and an index shard of compressed blocks."""

    def __init__(self, root: str, block_lines: int):
        self.fs, self.base = fs.FileSystem.from_uri(root)
        self.block_lines = block_lines
        context = TaskContext.get()
        self.name = f"{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        for folder in ("archive", "index"):
            self.fs.create_dir(f"{self.base}/{folder}", recursive=True)
        self.archives = 0
        self.out = None
        self.index = self.fs.open_output_stream(f"{self.base}/index/{self.name}.idx", compression=None)
        self.index_at = 0
        self.lines: list[str] = []

    def add(self, data: bytes) -> tuple[str, int, int]:
        if self.out is None or self.at > ARCHIVE_BYTES:
            if self.out is not None:
                self.out.close()
            self.archive = f"archive/{self.name}-{self.archives:04d}.warc.gz"
            self.out = self.fs.open_output_stream(f"{self.base}/{self.archive}", compression=None)
            self.archives, self.at = self.archives + 1, 0
        member = gzip.compress(data, 6, mtime=0)
        self.out.write(member)
        place = self.archive, self.at, len(member)
        self.at += len(member)
        return place

    def line(self, key: str, entry: dict) -> tuple | None:
        self.lines.append(f"{key} {json.dumps(entry)}")
        return self.block() if len(self.lines) >= self.block_lines else None

    def block(self) -> tuple | None:
        if not self.lines:
            return None
        data = zlib.compress("\n".join(self.lines).encode("utf-8", "surrogatepass"))
        self.index.write(data)
        row = (self.lines[0].split(" ", 1)[0], self.lines[-1].split(" ", 1)[0], f"index/{self.name}.idx", self.index_at, len(data), len(self.lines))
        self.index_at += len(data)
        self.lines = []
        return row

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
        self.index.close()


def _directory(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["first_key", "last_key", "shard", "offset", "length", "lines"])


def _write(batches: Iterator[pa.RecordBatch], root: str, date: str, block_lines: int) -> Iterator[pa.RecordBatch]:
    shard, rows = None, []
    for batch in batches:
        payloads = batch.column("payload")
        rest = zip(*(batch.column(n).to_pylist() for n in ("key", "id", "url", "refers_to")), strict=True)
        for i, (key, page_id, url, refers_to) in enumerate(rest):
            shard = shard or _Shard(root, block_lines)
            payload = payloads[i].as_py()
            kind, digest = "response" if refers_to is None else "revisit", _digest(payload)
            archive, offset, length = shard.add(record(kind, url, page_id, payload, digest, date, refers_to))
            done = shard.line(key, {"id": page_id, "url": url, "type": kind, "digest": digest, "bytes": len(payload), "refers_to": refers_to, "file": archive, "offset": offset, "length": length})
            if done:
                rows.append(done)
    if shard is not None:
        if done := shard.block():
            rows.append(done)
        shard.close()
        yield _directory(rows)


def _surt_column(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [key_of(u) for u in batch.column("url").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *batch.columns], ["key", *batch.schema.names])


def write(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", block_lines: int = BLOCK_LINES) -> DataFrame:
    """Write archives and index below ``root`` (a URI that all executors reach); return the block directory."""
    raw = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    sized = raw.withColumn("name", F.unhex(F.sha2("payload", 256))).withColumn("size", F.length("payload"))
    alike = sized.where(F.col("size") >= min_bytes).groupBy("name").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where("n > 1 and first_id is not null")
    alike, _ = materialise(alike, "payloads")
    refers = F.when((F.col("size") >= min_bytes) & (F.col("id").isNull() | (F.col("id") > F.col("first_id"))), F.col("first_id"))
    rows = sized.join(F.broadcast(alike), "name", "left") if alike.count() <= BROADCAST_GROUPS else join_hot(sized, alike, "name", "n", "left")
    rows = rows.select("id", "url", "payload", refers.alias("refers_to"))
    keyed = rows.mapInArrow(_surt_column, "key string, id long, url string, payload binary, refers_to long")
    ordered = keyed.repartitionByRange("key", "url", "id").sortWithinPartitions("key", "url", "id")
    directory = ordered.mapInArrow(partial(_write, root=root, date=date, block_lines=block_lines), DIRECTORY)
    directory.write.mode("overwrite").parquet(f"{root}/directory")
    return open_index(pages.sparkSession, root)


def open_index(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(DIRECTORY).parquet(f"{root}/directory")


class Reader:
    """Byte ranges and blocks of the archives below a root."""

    def __init__(self, root: str):
        self.fs, self.base = fs.FileSystem.from_uri(root)

    def range(self, name: str, offset: int, length: int) -> bytes:
        with self.fs.open_input_file(f"{self.base}/{name}") as f:
            return f.read_at(length, offset)

    def lines(self, shard: str, offset: int, length: int) -> list[str]:
        """The index lines of a block, in order of key."""
        return zlib.decompress(self.range(shard, offset, length)).decode("utf-8", "surrogatepass").split("\n")


def _shards_of(batches: Iterator[pa.RecordBatch], shards: list[tuple[str, str, str]]) -> Iterator[pa.RecordBatch]:
    """``shard, key``: a binary search among the shards' key ranges for each key. Shards do not overlap but in the keys at their ends."""
    first, last = [s[0] for s in shards], [s[1] for s in shards]
    for batch in batches:
        shard, key = [], []
        for k in batch.column("key").to_pylist():
            for i in range(bisect.bisect_left(last, k), bisect.bisect_right(first, k)):
                shard.append(shards[i][2])
                key.append(k)
        yield pa.RecordBatch.from_arrays([pa.array(shard, pa.string()), pa.array(key, pa.string())], ["shard", "key"])


def _search(keys: pa.Table, blocks: pa.Table, root: str) -> pa.Table:
    """The captures of some keys in a shard, by binary searches in its part of the directory and in the blocks found."""
    found: list[tuple] = []
    if keys.num_rows and blocks.num_rows:
        reader = Reader(root)
        rows = sorted(zip(*(blocks[c].to_pylist() for c in ("offset", "first_key", "last_key", "shard", "length")), strict=True))
        first, last = [r[1] for r in rows], [r[2] for r in rows]
        wanted: dict[int, list[str]] = {}
        for key in sorted(keys["key"].to_pylist()):
            for i in range(bisect.bisect_left(last, key), bisect.bisect_right(first, key)):
                wanted.setdefault(i, []).append(key)
        for i in sorted(wanted):
            offset, _, _, shard, length = rows[i]
            lines = reader.lines(shard, offset, length)
            for key in wanted[i]:
                at = bisect.bisect_left(lines, f"{key} ")
                while at < len(lines) and lines[at].startswith(f"{key} "):
                    e = json.loads(lines[at].split(" ", 1)[1])
                    found.append((key, e["id"], e["url"], e["file"], e["offset"], e["length"]))
                    at += 1
    types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
    columns = zip(*found, strict=True) if found else [[]] * len(types)
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["key", "id", "url", "file", "offset", "length"])


def locate(directory: DataFrame, root: str, urls: DataFrame, url_col: str = "url") -> DataFrame:
    """``key, id, url, file, offset, length`` of the captures whose SURT key is that of one of the URLs, each once."""
    shards = directory.groupBy("shard").agg(F.min("first_key").alias("first"), F.max("last_key").alias("last"))
    ranges = sorted((r["first"], r["last"], r["shard"]) for r in shards.collect())  # a row a writing task
    named = urls.select(F.col(url_col).cast("string").alias("url")).mapInArrow(_surt_column, "key string, url string")
    keys = named.select("key").distinct().mapInArrow(partial(_shards_of, shards=ranges), "shard string, key string")

    def search(keys_of_shard: pa.Table, blocks: pa.Table) -> pa.Table:
        return _search(keys_of_shard, blocks, root)

    return keys.groupBy("shard").cogroup(directory.groupBy("shard")).applyInArrow(search, FOUND)


def _fetch(batches: Iterator[pa.RecordBatch], root: str, with_payload: bool) -> Iterator[pa.RecordBatch]:
    reader = Reader(root)
    types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    for batch in batches:
        entries = [dict(zip(batch.schema.names, r, strict=True)) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        at = 0
        while at < len(entries):
            first, end = entries[at], at + 1
            while end < len(entries) and entries[end]["file"] == first["file"] and entries[end]["offset"] == entries[end - 1]["offset"] + entries[end - 1]["length"] and entries[end]["offset"] - first["offset"] < READ_BYTES:
                end += 1
            data = reader.range(first["file"], first["offset"], entries[end - 1]["offset"] + entries[end - 1]["length"] - first["offset"])
            rows = []
            for e in entries[at:end]:
                start = e["offset"] - first["offset"]
                headers, http, payload = parse_record(gzip.decompress(data[start : start + e["length"]]))
                kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
                if kind == "response" and (len(payload) != size or _digest(payload) != digest):
                    raise ValueError(f"damaged record in {e['file']} at {e['offset']}")
                page_id, refers_to = headers.get("WARC-Page-ID"), headers.get("WARC-Refers-To-Page-ID")
                rows.append((e["key"], None if page_id is None else int(page_id), e["url"], size, digest, kind, None if refers_to is None else int(refers_to), payload if with_payload else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["key", "id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
            at = end


def fetch(found: DataFrame, root: str, with_payload: bool = False) -> DataFrame:
    """The records at the places that :func:`locate` gave, read from the archives, their payloads checked against their digests."""
    found, _ = materialise(found, "found")
    size = found.agg(F.sum("length")).first()[0] or 0
    tasks = min(max(-(-size // TASK_BYTES), found.sparkSession.sparkContext.defaultParallelism), READ_TASKS)
    placed = found.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return placed.mapInArrow(partial(_fetch, root=root, with_payload=with_payload), RECORD)


def lookup(directory: DataFrame, root: str, urls: DataFrame, url_col: str = "url") -> DataFrame:
    """The captures of some URLs with their payloads; those that spell the URL otherwise but share its key are among them."""
    return fetch(locate(directory, root, urls, url_col), root, True)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, with_payload: bool = False) -> DataFrame:
    """Write the pages as archives in the shared folder and read them back by their keys: one row for each page."""
    root = scratch_path(pages.sparkSession, "warc")
    directory = write(pages, root, id_col, url_col, payload_col, min_bytes)
    return fetch(locate(directory, root, pages, url_col), root, with_payload)
