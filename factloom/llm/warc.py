"""WARC archives with a two-level capture index.

Captures are sorted by reversed-host URL key (``com,example)/path``) over range partitions; every partition
is one archive of separately gzipped records, an index file of compressed blocks of sorted key lines, and
a sparse directory with the first key of every block. A look-up searches the archives' first keys (the
manifest), binary-searches the directory, reads one block, and then one record, all by range reads.

Of records with equal payloads of at least ``least`` bytes the one with the smallest page_id is a response;
the others are revisits that refer to it and hold no payload. Archives are read back through their indexes: the
directory of an archive names its blocks, a block names the places of its records, and these are read by range.

Archives go to the shared folder under names unique to the task attempt; only those named in the manifest
that Spark commits count.

Edge cases: null html is an empty payload; a null url has the key ``-``; of rows with one payload and the smallest page_id, under one
address or several, exactly one is the response and the rest revisit it; a null page_id sorts behind all others, and where all page_ids
of a payload are null one row is the response that the others refer to; equal keys are ordered by page_id and may span archives and blocks; very long payloads are one record, read whole; an empty table
writes no archive; extra columns are ignored whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import json
import posixpath
import re
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, file_system, fresh_dir, materialize, small_batches

BLOCK_LINES = 128
#: Bytes that one range read asks for, unless a single record is larger.
RANGE_BYTES = 4 << 20
#: Bytes of html per archive, about.
ARCHIVE_MB = 64
DATE = "1970-01-01T00:00:00Z"
TYPES = {"response", "revisit"}


def surt(url: Column) -> Column:
    """Reversed-host key: lower-case host labels reversed and joined by commas, then ``)`` and the rest."""
    u = F.coalesce(url, F.lit("-"))
    host = F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rest = F.regexp_extract(u, r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(.*)$", 1)
    return F.when(host == "", u).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest))


def captures(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, key, payload, sha; of repeated payloads, first_id and place: page_id and hashed key of the response."""
    p = pages.select("page_id", "url", surt(F.col("url")).alias("key"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    p = p.withColumns({"sha": F.sha1("payload"), "at": F.xxhash64("key")})
    first = F.min(F.struct(F.col("page_id").isNull(), "page_id", "at")).alias("first")
    repeated = p.groupBy("sha", F.octet_length("payload").alias("n")).agg(first, F.count("*").alias("copies"))
    repeated = repeated.where((F.col("copies") > 1) & (F.col("n") >= least)).select("sha", F.col("first.page_id").alias("first_id"), F.col("first.at").alias("place"))
    repeated = materialize(repeated, "warc-repeats")
    return p.join(F.broadcast(repeated) if bounded(repeated) else repeated, "sha", "left")


def record(kind: str, url: str, page_id, digest: str, size: int, refers, payload: bytes) -> bytes:
    """One WARC record; a revisit has the payload's digest and size but no payload."""
    clean = lambda s: re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", s)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {clean(url)}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
    body = http + payload
    return "\r\n".join([*head, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(headers, HTTP head, payload) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    return fields, http, payload


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Writer:
    """One archive with its index blocks and directory, written as the sorted rows come."""

    def __init__(self, fs: pafs.FileSystem, base: str):
        self.name = uuid.uuid4().hex
        self.out, self.cdx = fs.open_output_stream(f"{base}/{self.name}.warc.gz", compression=None), fs.open_output_stream(f"{base}/{self.name}.cdx")
        self.at = self.cdx_at = self.n = 0
        self.lines: list[str] = []
        self.directory: list[list] = []
        self.first = None

    def add(self, key: str, page_id, data: bytes) -> None:
        z = _gzip(data)
        self.out.write(z)
        self.first = key if self.first is None else self.first
        self.lines.append(json.dumps([key, page_id, self.at, len(z)], ensure_ascii=False))
        self.at, self.n = self.at + len(z), self.n + 1
        if len(self.lines) == BLOCK_LINES:
            self.flush()

    def flush(self) -> None:
        if self.lines:
            block = _gzip("\n".join(self.lines).encode())
            self.cdx.write(block)
            self.directory.append([json.loads(self.lines[0])[0], self.cdx_at, len(block)])
            self.cdx_at += len(block)
            self.lines = []

    def close(self) -> dict:
        self.flush()
        tail = json.dumps(self.directory, ensure_ascii=False).encode()
        self.cdx.write(tail + struct.pack("<q", len(tail)))
        self.cdx.close()
        self.out.close()
        return {"first_key": self.first, "archive": self.name, "n": self.n, "n_bytes": self.at}


def write_archives(pages: DataFrame, least: int = 0, uri: str | None = None) -> tuple[str, DataFrame]:
    """Writes all captures; returns the folder and the manifest (first_key, archive, n, n_bytes)."""
    spark = pages.sparkSession
    small_batches(spark)
    uri = uri or fresh_dir(spark, "warc")
    all_ = captures(pages, least)
    mb = (pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0) / 1e6
    parts = max(1, round(mb / ARCHIVE_MB), min(int(spark.conf.get("spark.sql.shuffle.partitions")), int(mb / 4)))
    # Null unless the payload repeats; then whether the row is one of those that may be its response.
    may = F.when(F.col("place").isNotNull(), F.col("page_id").eqNullSafe(F.col("first_id")) & (F.col("at") == F.col("place")))
    rows = all_.select("key", "page_id", F.coalesce("url", F.lit("")).alias("url"), "payload", "sha", "first_id", may.alias("may"))
    order = ["key", F.col("page_id").asc_nulls_last(), "sha"]
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(uri)
        fs.create_dir(base, recursive=True)
        w, before = None, None
        for b in batches:
            for key, page_id, url, payload, sha, first, may in zip(*(c.to_pylist() for c in b.columns), strict=True):
                w = w or _Writer(fs, base)
                again, before = before == (key, page_id, sha), (key, page_id, sha)
                kind = "revisit" if may is False or may and again else "response"
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                w.add(key, page_id, record(kind, url, page_id, digest, len(payload), first, payload if kind == "response" else b""))
        if w:
            yield pa.RecordBatch.from_pylist([w.close()])

    return uri, materialize(ordered.mapInArrow(write, "first_key string, archive string, n long, n_bytes long"), "warc-manifest")


def read_archives(uri: str, manifest: DataFrame) -> DataFrame:
    """Per record that the indexes name: page_id, payload_bytes, payload_digest, record_type, refers_to. Payloads are checked."""
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = 0
                for rows in archived(*file_system(uri), name):
                    got += len(rows)
                    yield pa.RecordBatch.from_pylist(rows, schema)
                if got != n:
                    raise ValueError(f"{name} has {got} of {n} records")

    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    return manifest.select("archive", "n").repartition(parts, "archive").mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def directory_of(cdx) -> list[list]:
    """(first key, offset, length) of each block of an index file."""
    (size,) = struct.unpack("<q", cdx.read_at(8, cdx.size() - 8))
    return json.loads(cdx.read_at(size, cdx.size() - 8 - size))


def block_of(cdx, at: int, size: int) -> list[list]:
    """(key, page_id, offset, length) of each capture of a block."""
    return [json.loads(line) for line in zlib.decompress(cdx.read_at(size, at), 31).decode().split("\n")]


def archived(fs: pafs.FileSystem, base: str, name: str) -> Iterator[list[dict]]:
    """The records of an archive by blocks of its index. Neighbouring records are read together, up to ``RANGE_BYTES``."""
    with fs.open_input_file(f"{base}/{name}.cdx") as cdx, fs.open_input_file(f"{base}/{name}.warc.gz") as f:
        before = ""
        for first, at, size in directory_of(cdx):
            lines = block_of(cdx, at, size)
            if lines[0][0] != first or any(a[0] > b[0] for a, b in zip([[before], *lines], lines, strict=False)):
                raise ValueError(f"the index of {name} is out of order")
            before, rows = lines[-1][0], []
            for ids, start, data in ranges(f, lines):
                for page_id, offset, length in ids:
                    rows.append(row_of(zlib.decompress(data[offset - start : offset - start + length], 31)))
                    if rows[-1]["page_id"] != page_id:
                        raise ValueError(f"{name} has another record at {offset}")
            yield rows


def ranges(f, lines: list[list]) -> Iterator[tuple[list[tuple], int, bytes]]:
    """Runs of adjacent records as ((page_id, offset, length) of each, the run's offset, its bytes)."""
    run: list[tuple] = []
    for _, page_id, offset, length in [*lines, [None, None, -1, 0]]:
        if run and (offset != run[-1][1] + run[-1][2] or offset + length - run[0][1] > RANGE_BYTES):
            start = run[0][1]
            yield run, start, f.read_at(run[-1][1] + run[-1][2] - start, start)
            run = []
        run.append((page_id, offset, length))


def _id(urn: str) -> int | None:
    value = urn[len("<urn:page:") : -1]
    return None if value == "None" else int(value)


def row_of(data: bytes) -> dict:
    fields, http, payload = parse(data)
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    if kind not in TYPES or kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    refers = _id(fields["WARC-Refers-To"]) if kind == "revisit" else None
    return {"page_id": _id(fields["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": refers}


class CaptureIndex:
    """Looks captures up by URL key with range reads; holds only the archives' first keys."""

    def __init__(self, uri: str, manifest: list[tuple[str, str]]):
        self.fs, self.base = file_system(uri)
        self.archives = sorted(manifest)

    @staticmethod
    def _from(firsts: list[str], key: str) -> range:
        """Places that may hold ``key``: the last one that begins before it, and all that begin with it."""
        begin = max(0, bisect_right(firsts, key) - 1)
        while begin and firsts[begin] == key:
            begin -= 1
        return range(begin, bisect_right(firsts, key))

    def find(self, key: str) -> list[tuple[int, str, int, int]]:
        """(page_id, archive, offset, length) of all captures of ``key``."""
        found = []
        for a in self._from([k for k, _ in self.archives], key):
            name = self.archives[a][1]
            f = self.fs.open_input_file(f"{self.base}/{name}.cdx")
            directory = directory_of(f)
            for d in self._from([k for k, _, _ in directory], key):
                _, at, size = directory[d]
                found += [(page_id, name, offset, length) for k, page_id, offset, length in block_of(f, at, size) if k == key]
        return found

    def read(self, archive: str, offset: int, length: int) -> tuple[dict[str, str], bytes, bytes]:
        f = self.fs.open_input_file(posixpath.join(self.base, f"{archive}.warc.gz"))
        return parse(zlib.decompress(f.read_at(length, offset), 31))
