import json
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from factloom.operators import store
from factloom.sources import web
from factloom.streaming import ambient

T0 = NOW = datetime(2024, 1, 1)
EVENTS = [(1, 0, "session_start"), (1, 5, "working"), (1, 9, "idle"), (1, 12, "turn_complete"), (2, 0, "working"), (2, 500, "working"), (2, 601, "working"), (2, 610, "bogus")]


def events(spark):
    return spark.createDataFrame([(s, T0 + timedelta(seconds=t), e) for s, t, e in EVENTS], "session_id long, ts timestamp, event_type string")


def want():
    return [(1, 0, "active_work"), (1, 9, "waiting_or_idle"), (1, 12, "turn_complete"), (2, 0, "active_work"), (2, 601, "active_work")]


def seconds(rows):
    return sorted((r.session_id, int((r["at"] - T0).total_seconds()), r.state) for r in rows)


def test_changes_and_posture(spark):
    got = ambient.changes(events(spark))
    assert seconds(got.collect()) == want()
    now = F.lit(T0 + timedelta(seconds=700)).cast("timestamp")
    assert {r.session_id: (r.state, r.posture) for r in ambient.current(got, now).collect()} == {1: ("unknown", "quiet"), 2: ("active_work", "active")}


def test_stream_equals_batch(spark, tmp_path):
    events(spark).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session_id long, ts timestamp, event_type string").parquet(str(tmp_path / "in"))
    q = ambient.changes_stream(stream).writeStream.format("memory").queryName("changes").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert seconds(spark.table("changes").collect()) == want()


def test_stale_states_go_by_event_time(spark, tmp_path):
    """Files in the order of time, one a batch: the first session is long stale when the last file comes."""
    rows = [(1, 0, "working"), (2, 5_000, "idle"), (2, 5_001, "idle"), (1, 9_000, "working"), (1, 9_001, "working")]
    for n, (s, t, e) in enumerate(rows):
        frame = spark.createDataFrame([(s, T0 + timedelta(seconds=t), e)], "session_id long, ts timestamp, event_type string")
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
        q = ambient.changes_stream(stream, lateness="1 second").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert seconds(spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 0, "active_work"), (1, 9_000, "active_work"), (2, 5_000, "waiting_or_idle")]


def test_a_feed_does_not_repeat_within_hours(spark, tmp_path):
    shown = [("f", 0, 1), ("f", 3_000, 1), ("g", 10, 2), ("f", 30_000, 1)]
    spark.createDataFrame([(f, T0 + timedelta(seconds=t)) for f, t, _ in shown], "fingerprint string, exposed_at timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    pulses = spark.createDataFrame([("f", "p1"), ("g", "p2")], "fingerprint string, pulse_id string")
    stream = spark.readStream.schema("fingerprint string, exposed_at timestamp").parquet(str(tmp_path / "in"))
    q = ambient.cooldown_stream(pulses, stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = [(r.fingerprint, r.pulse_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == [("f", "p1"), ("g", "p2")]


def test_acknowledged_sink_ignores_replays(spark, tmp_path):
    rows = spark.createDataFrame([("e1", 1), ("e1", 1), ("e2", 2)], "id string, v int")
    rows.write.parquet(str(tmp_path / "in"))
    for run in ("a", "b"):
        stream = spark.readStream.schema("id string, v int").parquet(str(tmp_path / "in"))
        q = ambient.acknowledged("id", stream, str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / run)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["e1", "e2"]


def test_debounce_is_a_fold(spark):
    rows = [(1, T0 + timedelta(seconds=t), "idle") for t in (0, 0.6, 1.2)]
    got = ambient.debounce(spark.createDataFrame(rows, "session_id long, ts timestamp, event_type string"))
    assert sorted((r.ts - T0).total_seconds() for r in got.collect()) == [0, 1.2]


def test_capabilities(spark):
    rows = spark.createDataFrame([("claude", "turn_complete"), ("claude", "working"), ("opencode", "working"), ("manual", "idle"), ("who", "idle")], "adapter string, event_type string")
    assert sorted((r.adapter, r.event_type, r.job_status) for r in ambient.normalize(rows).collect()) == [("claude", "turn_complete", "succeeded"), ("opencode", "working", "running")]


def test_feeds(spark):
    rss = "<rss><channel><item><title>A</title><link>https://example.test/a?utm_source=x</link></item><item><title>B</title><link>not-a-url</link></item></channel></rss>"
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title> </title><link href="https://example.test/b"/></entry></feed>'
    got = web.feed_items(spark.createDataFrame([("f", rss), ("g", atom)], "feed_url string, xml string"))
    assert sorted((r.canonical_locator, r.title) for r in got.collect()) == [("https://example.test/a", "A"), ("https://example.test/b", "https://example.test/b")]
    assert web.deduplicated(got, got.where("title = 'A'")).count() == 1


def test_json_answers(spark):
    frame = lambda x: spark.createDataFrame([(json.dumps(x),)], "json string")
    repo = web.repositories(frame({"items": [{"html_url": "https://github.com/a/b", "full_name": "a/b", "description": None}]})).first()
    assert repo.identity_key == "repo:a/b" and repo.metadata == {"full_name": "a/b"}
    papers = web.papers(frame({"data": [{"paperId": "1", "title": "t", "url": "", "year": 2020}, {"paperId": None, "title": "x"}]})).collect()
    assert [p.identity_key for p in papers] == ["paper:1"]
    assert web.papers(frame([{"paperId": "2", "title": "t"}])).first().identity_key == "paper:2"
    got = web.videos(frame({"items": [{"id": "abc", "snippet": {"title": "t"}}, {"id": {"videoId": "def"}, "snippet": {"title": "u"}}]})).collect()
    assert sorted(v.identity_key for v in got) == ["video:abc", "video:def"]


def test_documents_by_type(spark):
    page = "<html><nav>menu</nav><script>x</script><p>Version control stores snapshots.</p><p>It is useful.</p></html>"
    rows = [("h", page.encode(), "text/html"), ("p", "a \n b".encode(), "text/plain"), ("u", b"\xff", "text/plain"), ("z", b"x", "image/png")]
    got = {r.k: r for r in web.parse_documents(spark.createDataFrame(rows, "k string, body binary, mime_type string")).collect()}
    assert got["h"].text == "Version control stores snapshots. It is useful." and got["p"].text == "a b"
    assert got["u"].error == "unreadable" and got["z"].error == "unsupported_type"


def test_fetch_retries_and_cuts():
    calls, waits = [], []

    class Answer:
        status, headers = 200, {"Content-Type": "text/plain; x"}

        def __enter__(self):
            return self

        def __exit__(self, *_):
            return None

        def read(self, n):
            return b"x" * n

    def opener(request, timeout):
        calls.append(request)
        if len(calls) < 3:
            raise OSError
        return Answer()

    got = web.fetch("http://a.test/", max_bytes=5, opener=opener, sleep=waits.append)
    assert got["body"] == b"xxxxx" and got["truncated"] and got["mime_type"] == "text/plain" and waits == [0.25, 0.5] and web.retry_delay(2) == 1.0


class Answer:
    def __init__(self, status, body, headers=()):
        self.status, self.body, self.headers = status, body, dict(headers)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return None

    def read(self, n):
        return self.body[:n]


def test_json_services_tell_what_went_wrong():
    import urllib.error

    def ask(status, body=b"[]", headers=(), **how):
        seen = []

        def opener(request, timeout):
            seen.append(request)
            if status != 200:
                raise urllib.error.HTTPError(request.full_url, status, "", dict(headers), None)
            return Answer(status, body, headers)

        got = web.fetch_json("http://a.test/", web.RequestBudget(1), opener=opener, sleep=lambda _: None, **how)
        return got["json"], got["error"], got["retry_after"], len(seen), seen[0].get_method()

    assert ask(200, b'{"a": 1}') == ('{"a": 1}', None, None, 1, "GET")
    assert ask(200, b'"text"')[1] == ask(200, b"{")[1] == "not_json" and ask(200, b"[" * 40, max_bytes=10)[1] == "too_large"
    assert ask(429, headers={"Retry-After": "30"})[1:4] == ("rate_limited", 30, 3) and ask(403, headers={"Retry-After": "5"})[1:3] == ("rate_limited", 5)
    assert ask(403)[1:4] == ("permanent", None, 1) and ask(503)[1:4] == ("transient", None, 3)
    assert ask(503, post={"ids": [1]})[1:] == ("transient", None, 1, "POST")  # a POST is sent once
    budget = web.RequestBudget(1)
    for _ in range(3):
        budget.take()
    with pytest.raises(web.BudgetSpent):
        budget.take()


def test_ids_go_in_batches(spark):
    ids = spark.range(3000).select((F.col("id") % 2500).cast("string").alias("id"))
    got = web.batches(ids, most=5).collect()
    assert max(len(b.ids) for b in got) == 5 and sorted(i for b in got for i in b.ids) == sorted(map(str, range(2500))) and len({b.batch for b in got}) == len(got)


def test_cached_answers(spark):
    caches = spark.createDataFrame([("a", "s1", "e", None, "d1"), ("b", "s2", None, "l", "gone"), ("c", "s3", "e", "l", "gone")], "cache_key string, content_sha256 string, etag string, last_modified string, document_id string")
    asked = store.request_headers(spark.createDataFrame([("a",), ("b",), ("new",)], "cache_key string"), caches)
    assert {r.cache_key: r.headers for r in asked.collect()} == {"a": {"If-None-Match": "e"}, "b": {"If-Modified-Since": "l"}, "new": {}}
    documents = spark.createDataFrame([("d1", "s1", 1), ("d2", "s2", 1), ("d3", "s2", 2)], "id string, content_sha256 string, captured_at long")
    chunks = spark.createDataFrame([("c2", "d1", 1, "two"), ("c1", "d1", 0, "one"), ("c3", "d3", 0, "three")], "id string, document_id string, ordinal int, text string")
    actions = spark.createDataFrame([("a", "reuse"), ("b", "reuse"), ("c", "reuse"), ("x", "fetch")], "cache_key string, action string")
    got = {r.cache_key: (r.document_id, [c.text for c in r.chunks]) for r in store.reloaded(actions, caches, documents, chunks).collect()}
    assert got == {"a": ("d1", ["one", "two"]), "b": ("d3", ["three"])}
    answer = spark.createDataFrame([("a", "fetch", b"x", "e2", None, "p", "d9"), ("b", "reuse", None, None, None, "p", None)], "cache_key string, action string, body binary, etag string, last_modified string, parser_version string, document_id string")
    assert [(r.cache_key, r.etag, len(r.content_sha256)) for r in store.cache_updates(answer, NOW).collect()] == [("a", "e2", 64)]


def test_jobs_are_made_once(spark):
    jobs = spark.createDataFrame([("j", "k1", "succeeded")], "id string, idempotency_key string, status string")
    new = spark.createDataFrame([("k1", "build"), ("k2", "build"), ("k2", "build")], "idempotency_key string, stage string")
    assert [(r.idempotency_key, r.status) for r in store.create_jobs(jobs, new, NOW).collect()] == [("k2", "pending")]


HOSTILE = ("<a " * 700_000, "<a '" * 500_000, '<a "' * 400_000 + ">", "<a ' \" >" * 250_000, "</ " * 600_000, "<! " * 600_000, "<script " * 250_000, "<script>" * 250_000, "<!--" * 500_000, "</script" * 250_000, "<" * 2_000_000, "<a \"'" * 400_000, "<a '>'" * 300_000, "<x" * 1_000_000)


def test_pages_of_two_megabytes_take_no_longer_than_others():
    for page in HOSTILE:
        start = time.perf_counter()
        web.main_text(page)
        assert time.perf_counter() - start < 8, page[:12]


def test_markup_that_does_not_end():
    for page, text in (
        ("a <b", "a <b"), ("a <b <i>c", "a c"), ("a <!-- b", "a"), ("</<!-- b", "</"), ("a <script>b", "a"), ("a <script>b</script >c", "a c"), ("x <p title='>'>y", "x y"), ("x <p title=\"it's\">y", "x y"), ("x <p it's>y</p>z", "x y z"),
        ("<nav>a <b>b</b></nav>c", "c"), ("<header/>a", "a"), ("<script/>a", "a"), ("</nav>a", "a"), ("1 < 2 &amp; 3 > 2", "1 < 2 & 3 > 2"), ("a </ b> c", "a c"), ("</>a", "</>a"), ("", ""), (None, ""),
    ):
        assert web.main_text(page) == text, page


def test_pdf_checks(spark):
    rows = [(1, b"%PDF-1.4 /Type /Page /Type /Pages"), (2, b"no"), (3, b"%PDF-1.4" + b" /Type /Page" * 4), (4, b"%PDF-" + b"x" * 300)]
    got = spark.createDataFrame(rows, "id int, body binary").select("id", web.pdf_checks(F.col("body"), 3, 200).alias("why")).collect()
    assert {r.id: r.why for r in got} == {1: None, 2: "not_pdf", 3: "too_many_pages", 4: "too_large"}
