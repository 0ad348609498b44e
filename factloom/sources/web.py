"""Reading pages, feeds and JSON answers of discovery services. Parsing of answers is native; HTML goes through Arrow."""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pyspark.sql.types import StringType

from factloom.functions import text as T

DROPPED = frozenset({"script", "style", "nav", "header", "footer"})
HTML_TYPES = ("text/html", "application/xhtml+xml")
PARSERS = {"text/html": ("html-main-1", "html-fallback-1"), "application/xhtml+xml": ("html-main-1", "html-fallback-1"), "text/plain": ("plain-1",), "application/pdf": ("pdf-1",)}
#: Statuses that are tried again.
TRANSIENT = (408, 425, 429, 500, 502, 503, 504)


#: Where markup may begin: comments, declarations, tags and what looks like an end tag.
OPENED = re.compile(r"<(?:(?P<comment>!--)|[!?]|(?P<end>/)?(?P<name>[A-Za-z][^\s/>]*)|/[^A-Za-z>])")
ENDS = re.compile(r"""[>"']""")
RAW = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style")}


class _Page:
    """A page read once from its begin. Whatever a search finds missing is missing for the rest as well, and is not searched for again."""

    def __init__(self, html: str):
        self.html, self.last = html, html.rfind(">")
        self.gone: set[str] = set()  # quotes that do not occur any more
        self.plain = False  # quotes hide no ">" any more

    def tag_end(self, at: int) -> int:
        """The place behind a tag whose name ends at ``at``: of the first ">" outside of quoted strings, else of the first."""
        i = at
        while not self.plain:
            m = ENDS.search(self.html, i)
            if m is None:
                self.plain = True
            elif m[0] == ">":
                return m.end()
            else:
                close = -1 if m[0] in self.gone else self.html.find(m[0], m.end())
                if close < 0:
                    self.gone.add(m[0])  # a quote alone is none
                i = m.end() if close < 0 else close + 1
        return self.html.find(">", at) + 1

    def markup(self) -> Iterator[tuple[int, int, str, int]]:
        """(start, end, name, step) of everything that is no text; step is 1 for a start tag, -1 for an end tag, 0 for anything else."""
        m = OPENED.search(self.html)
        while m is not None:
            if m.start() > self.last and not m["comment"]:  # only a comment needs no ">"
                at = self.html.find("<!--", m.start())
                m = OPENED.match(self.html, at) if at >= 0 else None
                continue
            name, step = (m["name"] or "").lower(), 0
            if m["comment"]:
                end = self.html.find("-->", m.end()) + 3
                end = end if end > 2 else len(self.html)
            elif not name:
                end = self.html.find(">", m.end() - (m[0][-1] == ">")) + 1
            else:
                end = self.tag_end(m.end())
                step = -1 if m["end"] else 0 if self.html[end - 2] == "/" else 1
                if step == 1 and name in RAW:
                    closed = RAW[name].search(self.html, end)
                    end, step = closed.end() if closed else len(self.html), 0
            yield m.start(), end, name, step
            m = OPENED.search(self.html, end)


def main_text(html: str | None) -> str:
    """The visible text of a page, single-spaced: what lies between its markup and in no dropped element. Time is in proportion to the page."""
    html, seen, inside, at = html or "", [], 0, 0
    for start, end, name, step in _Page(html).markup():
        seen.append("" if inside else html[at:start])
        at = end
        if name in DROPPED:
            inside = max(0, inside + step)
    seen.append("" if inside else html[at:])
    return " ".join(unescape(" ".join(seen)).split())


@F.pandas_udf(StringType())
def html_main_text(html: pd.Series) -> pd.Series:
    return html.map(main_text)


def extract_html(pages: DataFrame, precise: Column | None = None) -> DataFrame:
    """page_id, url, text and parser: the precise text if it is good enough, else the fallback's; NULL if neither is."""
    first = precise if precise is not None else F.lit(None).cast("string")
    both = pages.select("page_id", "url", first.alias("p"), html_main_text("html").alias("f"))
    good = lambda c: F.coalesce(T.html_quality(F.col(c)), F.lit(False))
    return both.select(
        "page_id", "url", F.when(good("p"), F.col("p")).when(good("f"), F.col("f")).alias("text"),
        F.when(good("p"), "html-main-1").when(good("f"), "html-fallback-1").alias("parser"),
    )


def parse_documents(responses: DataFrame, pdf_text: Column | None = None) -> DataFrame:
    """text, parser and error of responses (body binary, mime_type): dispatch by type; unknown types and undecodable text are errors."""
    plain = F.when(F.is_valid_utf8(F.col("body").cast("string")), T.norm_text(F.col("body").cast("string")))
    is_html, is_plain, is_pdf = F.col("mime_type").isin(*HTML_TYPES), F.col("mime_type") == "text/plain", F.col("mime_type") == "application/pdf"
    html = html_main_text(F.when(is_html, F.col("body").cast("string")))
    text = F.when(is_plain, plain).when(is_html & T.html_quality(html), html).when(is_pdf, pdf_text if pdf_text is not None else F.lit(None).cast("string"))
    parser = F.when(is_plain, "plain-1").when(is_html, "html-fallback-1").when(is_pdf, "pdf-1")
    out = responses.withColumns({"text": text, "parser": parser})
    known = F.col("parser").isNotNull()
    return out.withColumn("error", F.when(~known, "unsupported_type").when(F.col("text").isNull(), "unreadable"))


def pdf_checks(body: Column, max_pages: int = 50, max_bytes: int = 10_000_000) -> Column:
    """Why a PDF is refused before conversion, or NULL."""
    text = F.decode(body, "ISO-8859-1")
    return F.when(~F.startswith(text, F.lit("%PDF-")), "not_pdf").when(F.octet_length(body) > max_bytes, "too_large").when(F.regexp_count(text, F.lit(r"/Type\s*/Page\b(?!s)")) > max_pages, "too_many_pages")


def _source(kind: str, locator: Column, title: Column, metadata: Column) -> list[Column]:
    url = T.canonical_url(locator)
    meta = F.map_filter(metadata, lambda _, v: v.isNotNull())
    return [
        T.det_id("source", url, kind).alias("id"), F.lit(kind).alias("source_type"), url.alias("canonical_locator"), F.coalesce(F.nullif(F.trim(title), F.lit("")), url).alias("title"),
        F.lit("remote_untrusted").alias("trust"), meta.alias("metadata"), T.identity_key(meta, url).alias("identity_key"),
    ]


def feed_items(feeds: DataFrame) -> DataFrame:
    """RSS items and Atom entries of feeds (feed_url, xml) as sources; rows without a usable address go."""
    rss = "struct<channel:struct<item:array<struct<title:string,link:string>>>>"
    atom = "struct<entry:array<struct<title:string,link:array<struct<_href:string,_VALUE:string>>>>>"
    clean = F.regexp_replace("xml", r"\sxmlns(:\w+)?=\"[^\"]*\"", "")
    a = feeds.select("feed_url", F.explode(F.from_xml(clean, rss)["channel"]["item"]).alias("i")).select("feed_url", F.col("i.link").alias("link"), F.col("i.title").alias("title"))
    b = feeds.select("feed_url", F.explode(F.from_xml(clean, atom)["entry"]).alias("e"))
    b = b.select("feed_url", F.coalesce(F.try_element_at(F.filter(F.transform("e.link", lambda x: x["_href"]), lambda h: h.isNotNull()), F.lit(1)), F.get("e.link", F.lit(0))["_VALUE"]).alias("link"), F.col("e.title").alias("title"))
    both = a.unionByName(b).where(T.canonical_url(F.trim("link")).isNotNull())
    return both.select(*_source("web", F.trim("link"), F.col("title"), F.create_map(F.lit("feed"), F.col("feed_url"))))


def repositories(answers: DataFrame, limit: int = 100) -> DataFrame:
    """Repository search answers (query, json) as sources."""
    kind = "struct<items:array<struct<html_url:string,full_name:string,description:string>>>"
    rows = answers.select(F.explode(F.slice(F.from_json("json", kind)["items"], 1, min(limit, 100))).alias("r")).where(T.canonical_url(F.col("r.html_url")).isNotNull())
    return rows.select(*_source("github", F.col("r.html_url"), F.col("r.full_name"), F.create_map(F.lit("full_name"), F.col("r.full_name"), F.lit("description"), F.col("r.description"))))


def papers(answers: DataFrame, limit: int = 100) -> DataFrame:
    """Paper search, batch and recommendation answers (query, json) as sources; rows without paperId go."""
    kind = "array<struct<paperId:string,title:string,url:string,year:int>>"
    parsed = F.coalesce(F.from_json("json", f"struct<data:{kind}>")["data"], F.from_json("json", f"struct<recommendedPapers:{kind}>")["recommendedPapers"], F.from_json("json", kind))
    rows = answers.select(F.explode(F.slice(parsed, 1, min(limit, 100))).alias("p")).where("p.paperId IS NOT NULL AND p.paperId <> ''")
    url = F.coalesce(F.nullif(F.col("p.url"), F.lit("")), F.concat(F.lit("https://www.semanticscholar.org/paper/"), F.col("p.paperId")))
    return rows.select(*_source("scholar", url, F.col("p.title"), F.create_map(F.lit("paper_id"), F.col("p.paperId"), F.lit("year"), F.col("p.year").cast("string"))))


def videos(answers: DataFrame, limit: int = 50) -> DataFrame:
    """Video answers (query, json) as sources; an id is a string or an object with videoId."""
    rows = answers.select(F.explode(F.slice(F.from_json("json", "struct<items:array<struct<id:string,snippet:struct<title:string,channelTitle:string>>>>")["items"], 1, min(limit, 50))).alias("v"))
    video = F.coalesce(F.get_json_object(F.when(F.startswith("v.id", F.lit("{")), F.col("v.id")), "$.videoId"), F.when(~F.startswith("v.id", F.lit("{")), F.col("v.id")))
    named = rows.select("v", video.alias("vid")).where("vid IS NOT NULL")
    return named.select(*_source("youtube", F.concat(F.lit("https://www.youtube.com/watch?v="), F.col("vid")), F.col("v.snippet.title"), F.create_map(F.lit("video_id"), F.col("vid"))))


def explicit(urls: DataFrame) -> DataFrame:
    """Seeds (url, title) given by hand."""
    return urls.where(T.canonical_url(F.col("url")).isNotNull()).select(*_source("web", F.col("url"), F.col("title"), F.create_map(F.lit("origin"), F.lit("explicit"))))


def deduplicated(records: DataFrame, *existing: DataFrame) -> DataFrame:
    """Records once per locator and per identity, without those that an existing table holds."""
    out = records.dropDuplicates(["canonical_locator"]).dropDuplicates(["identity_key"])
    for table in existing:
        for key in ("canonical_locator", "identity_key"):
            out = out.join(table.select(key), key, "left_anti").select(*records.columns)
    return out


def retry_delay(attempt: int, base: float = 0.25) -> float:
    return base * 2**attempt


def fetch(url: str, headers: dict[str, str] | None = None, max_bytes: int = 2_000_000, timeout: float = 10.0, attempts: int = 3, opener: Callable | None = None, sleep: Callable[[float], None] = time.sleep, body: bytes | None = None) -> dict:
    """One bounded, conditional request; transient failures are tried again with growing delays. A body over the bound is cut and flagged.

    With ``body`` it is a POST, which is sent once.
    """
    opener, attempts = opener or urllib.request.urlopen, attempts if body is None else 1
    for attempt in range(attempts):
        status, got_body, got = None, b"", {}
        try:
            with opener(urllib.request.Request(url, data=body, headers=headers or {}), timeout=timeout) as r:
                status, got_body, got = r.status, r.read(max_bytes + 1), dict(r.headers)
        except urllib.error.HTTPError as e:
            status, got = e.code, dict(e.headers or {})
        except OSError:
            status = None
        if status is not None and status not in TRANSIENT or attempt == attempts - 1:
            break
        sleep(retry_delay(attempt))
    return {
        "url": url, "status": status, "body": got_body[:max_bytes], "truncated": len(got_body) > max_bytes, "mime_type": got.get("Content-Type", "").split(";")[0].strip().lower(),
        "etag": got.get("ETag"), "last_modified": got.get("Last-Modified"), "retry_after": got.get("Retry-After"),
    }


ANSWER = "cache_key string, source_id string, url string, status int, body binary, truncated boolean, mime_type string, etag string, last_modified string, retry_after string"


def fetched(requests: DataFrame, opener: Callable | None = None, pause: float = 0.0) -> DataFrame:
    """Answers to requests (cache_key, source_id, url, headers, host). All requests to a host are in one task, one after the other, ``pause`` seconds apart."""

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[str] = set()
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                if r.host in seen and pause:
                    time.sleep(pause)
                seen.add(r.host)
                rows.append((r.cache_key, r.source_id, *fetch(r.url, dict(r.headers or {}), opener=opener).values()))
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in ANSWER.split(", ")])

    return requests.select("cache_key", "source_id", "url", "headers", "host").repartition("host").mapInPandas(ask, ANSWER)


class BudgetSpent(RuntimeError):
    """No request is left."""


class RequestBudget:
    """Requests that one discovery may make: two more than the results it may give."""

    def __init__(self, limit: int):
        self.left, self.made, self.received = limit + 2, 0, 0

    def take(self) -> None:
        if not self.left:
            raise BudgetSpent(f"all {self.made} requests are made")
        self.left, self.made = self.left - 1, self.made + 1


def fetch_json(url: str, budget: RequestBudget, post: object = None, max_bytes: int = 1_000_000, **how) -> dict:
    """An answer of a JSON service: url, json (text of an object or array, else NULL), error and retry_after in seconds.

    Errors: rate_limited (429, or 403 that names a delay), transient, permanent, too_large (nothing is cut here), not_json.
    """
    budget.take()
    body = None if post is None else json.dumps(post).encode()
    r = fetch(url, {"Accept": "application/json"} | ({"Content-Type": "application/json"} if body else {}), max_bytes, body=body, **how)
    budget.received += len(r["body"])
    status, delay = r["status"], r["retry_after"] if (r["retry_after"] or "").isdigit() else None
    error, told = None, None
    if status == 429 or status == 403 and r["retry_after"]:
        error = "rate_limited"
    elif status is None or status in TRANSIENT:
        error = "transient"
    elif status != 200:
        error = "permanent"
    elif r["truncated"]:
        error = "too_large"
    else:
        try:
            told = r["body"].decode()
            error = None if isinstance(json.loads(told), dict | list) else "not_json"
        except ValueError:
            error = "not_json"
    return {"url": url, "json": told if error is None else None, "error": error, "retry_after": int(delay) if delay else None}


def batches(ids: DataFrame, column: str = "id", most: int = 100) -> DataFrame:
    """(batch, ids): distinct ids in groups of at most ``most``, for services that answer for many at once."""
    hashed = ids.select(column).distinct().select(column, F.floor((F.row_number().over(W.partitionBy(F.pmod(F.xxhash64(column), F.lit(256))).orderBy(column)) - 1) / most).alias("n"), F.pmod(F.xxhash64(column), F.lit(256)).alias("part"))
    return hashed.groupBy("part", "n").agg(F.sort_array(F.collect_list(column)).alias("ids")).select(F.concat_ws("-", "part", "n").alias("batch"), "ids")


class HttpSource(DataSource):
    """``spark.read.format("factloom_http").option("urls", "a b c")``: one partition per group of addresses.

    Instead of ``urls``, ``requests`` is a JSON list of objects with url and headers, such as those for conditional requests.
    """

    @classmethod
    def name(cls) -> str:
        return "factloom_http"

    def schema(self) -> str:
        return "url string, status int, body binary, truncated boolean, mime_type string, etag string, last_modified string, retry_after string"

    def reader(self, schema):
        return _HttpReader(self.options)


class _HttpReader(DataSourceReader):
    def __init__(self, options):
        told = json.loads(options["requests"]) if "requests" in options else [{"url": u} for u in options.get("urls", "").split()]
        self.requests, self.per, self.most = told, int(options.get("urls_per_partition", 20)), int(options.get("max_bytes", 2_000_000))

    def partitions(self):
        return [InputPartition(self.requests[k : k + self.per]) for k in range(0, len(self.requests), self.per)] or [InputPartition([])]

    def read(self, partition) -> Iterator[tuple]:
        for r in partition.value:
            yield tuple(fetch(r["url"], r.get("headers"), max_bytes=self.most).values())
