import base64
import hashlib
import json
import struct
import zlib

import pytest
from factloom.llm import warc as A

ROWS = [
    (3, "http://User@WWW.Example.com:80/a?x=1", "<p>one</p>"), (1, "https://b.example.org/é", "<p>two</p>"), (2, "http://a.example.com/", "<p>one</p>"),
    (4, None, None), (5, "nonsense\r\nX: y", ""), (6, "http://a.example.com/", "\r\n\r\nHTTP/1.1 " * 3000), (7, "http://a.example.com/", "WARC/1.1\r\n\r\n"),
    (8, "http://b.example.org/z", "x" * 3_000_000),
]


def brute(rows, least=0):
    first = {}
    for i, _, h in rows:
        p = (h or "").encode()
        first[p] = min(first.get(p, i), i)
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        again = len(p) >= least and first[p] != i
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", first[p] if again else None))
    return sorted(out)


def test_round_trip(spark):
    pages = spark.createDataFrame([(*r, "extra") for r in ROWS], "page_id long, url string, html string, sha string")
    for least in (0, 8, 12):
        assert sorted(map(tuple, A.read_archives(*A.write_archives(pages, least)).collect())) == brute(ROWS, least)


def test_repeated_rows_nulls_and_empty(spark):
    pages = spark.createDataFrame([(1, "http://a/", "x")] * 3 + [(None, "http://b/", "x")], "page_id long, url string, html string")
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in A.read_archives(*A.write_archives(pages)).collect()), key=str)
    assert got == sorted([(1, "response", None), (1, "revisit", 1), (1, "revisit", 1), (None, "revisit", 1)], key=str)
    assert A.read_archives(*A.write_archives(pages.limit(0))).count() == 0


def test_one_response_for_a_payload(spark):
    rows = [
        (1, "http://a.com/", "X"), (1, "http://b.com/", "X"), (2, "http://c.com/", "Y"), (2, "http://c.com/", "Z"), (2, "http://c.com/", "Y"), (9, "http://a.com/", "Y"),
        (None, "http://d.com/", "N"), (None, "http://e.com/", "N"), (None, "http://e.com/", "N"), (3, "http://f.com/", "alone"), (3, "http://g.com/", "other"), (None, "http://h.com/", None),
    ]
    got = A.read_archives(*A.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3))).collect()
    by = {}
    for r in got:
        by.setdefault(r.payload_digest, []).append(r)
    assert sorted(len(v) for v in by.values()) == [1, 1, 1, 1, 2, 3, 3]
    for group in by.values():
        [response] = [r for r in group if r.record_type == "response"]
        assert response.refers_to is None and all(r.refers_to == response.page_id for r in group if r is not response)
        assert response.page_id == min((r.page_id for r in group if r.page_id is not None), default=None)


def test_index_finds_every_capture(spark, monkeypatch):
    monkeypatch.setattr(A, "BLOCK_LINES", 4)
    monkeypatch.setattr(A, "ARCHIVE_MB", 0.002)
    rows = [(k, f"http://h{k % 7}.example.com/p{k % 60 // 3}", f"<p>{k}</p>" * 20) for k in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    uri, manifest = A.write_archives(pages)
    held = [(r.first_key, r.archive) for r in manifest.collect()]
    assert len(held) > 1
    index = A.CaptureIndex(uri, held)
    for url in {u for _, u, _ in rows}:
        key = "com,example," + url.split("//")[1].split(".")[0] + ")/" + url.rsplit("/", 1)[1]
        found = index.find(key)
        assert sorted(f[0] for f in found) == [k for k, u, _ in rows if u == url]
        for page_id, *place in found:
            fields, _, payload = index.read(*place)
            assert fields["WARC-Record-ID"] == f"<urn:page:{page_id}>" and payload == f"<p>{page_id}</p>".encode() * 20
    assert index.find("com,example,none)/") == [] and index.find("a") == [] and index.find("zz") == []


def test_keys(spark):
    got = spark.createDataFrame([(u,) for _, u, _ in ROWS], "u string").select(A.surt(A.F.col("u"))).collect()
    assert [r[0] for r in got][:5] == ["com,example,www)/a?x=1", "org,example,b)/é", "com,example,a)/", "-", "nonsense\r\nX: y"]


def test_rows_come_from_the_index(spark):
    """A line lost from a block, and one that points elsewhere, are told."""
    names = "page_id long, url string, html string, `payload` string, `key` string, `first_id` long, `a.b` string"
    pages = spark.createDataFrame([(k, f"http://h.example.com/{k}", f"<p>{k}</p>", "p", "k", 0, "x") for k in range(9)], names)
    uri, manifest = A.write_archives(pages)
    assert A.read_archives(uri, manifest).count() == 9
    for change in (lambda x: x[:-1], lambda x: [*x[:-1], [x[-1][0], x[-1][1], *x[0][2:]]]):
        folder = uri.removeprefix("file://")
        name = manifest.first().archive
        with open(f"{folder}/{name}.cdx", "rb") as f:
            data = f.read()
        (size,) = struct.unpack("<q", data[-8:])
        (first, at, n), *_ = json.loads(data[-8 - size : -8])
        lines = change([json.loads(x) for x in zlib.decompress(data[at : at + n], 31).decode().split("\n")])
        block = A._gzip("\n".join(json.dumps(x) for x in lines).encode())
        tail = json.dumps([[first, 0, len(block)]]).encode()
        with open(f"{folder}/{name}.cdx", "wb") as f:
            f.write(block + tail + struct.pack("<q", len(tail)))
        with pytest.raises(Exception, match="has (8 of 9 records|another record)"):
            A.read_archives(uri, manifest).collect()
        with open(f"{folder}/{name}.cdx", "wb") as f:
            f.write(data)


def test_ranges_join_neighbours_up_to_the_bound(monkeypatch):
    class File:
        def read_at(self, n, at):
            return bytes(range(at, at + n))

    lines = [["k", 1, 0, 4], ["k", 2, 4, 3], ["k", 3, 9, 2], ["k", 4, 11, 9], ["k", 5, 20, 1]]
    monkeypatch.setattr(A, "RANGE_BYTES", 8)
    got = [([i for i, *_ in ids], start, len(data)) for ids, start, data in A.ranges(File(), lines)]
    assert got == [([1, 2], 0, 7), ([3], 9, 2), ([4], 11, 9), ([5], 20, 1)]
