"""Web pages as Python data sources: conditional fetches of single URLs, and breadth-first crawls.

A crawl is one partition: politeness towards a host needs one requester. Many sites are many partitions."""

from __future__ import annotations

import hashlib
import json
import re
import time
import urllib.error
import urllib.request
import urllib.robotparser
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from email.utils import parsedate_to_datetime
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlsplit, urlunsplit

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from millrace.functions.urls import SKIPPED, request_spacing

AGENT = "millrace/0.1"
SCHEMA = "url string, depth int, status int, operation string, content_hash string, content binary, content_mime string, etag string, last_modified timestamp, error string"
MAX_DEPTH, MAX_PAGES = 10, 10_000

#: status, headers (lower-case names), body
Response = tuple[int, dict[str, str], bytes]
Fetch = Callable[[str, dict[str, str]], Response]


def http_fetch(url: str, headers: dict[str, str], timeout: float = 30) -> Response:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as r:
            return r.status, {k.lower(): v for k, v in r.headers.items()}, r.read()
    except urllib.error.HTTPError as e:
        return e.code, {k.lower(): v for k, v in e.headers.items()}, b""


def canonical(url: str) -> str:
    parts = urlsplit(urldefrag(url)[0])
    return urlunsplit((parts.scheme.lower(), parts.netloc.lower(), parts.path, parts.query, ""))


def origin(url: str) -> str:
    parts = urlsplit(url)
    return f"{parts.scheme}://{parts.netloc}"


class _Anchors(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found: list[str] = []

    def handle_starttag(self, tag, attrs):
        href = next((v for k, v in attrs if k == "href" and v), None) if tag == "a" else None
        if href and href.strip() and not href.strip().startswith(SKIPPED):
            self.found.append(href.strip())


def links(body: bytes, base: str) -> list[str]:
    parser = _Anchors()
    parser.feed(body.decode("utf-8", "replace"))
    return [u for u in (urljoin(base, h) for h in parser.found) if urlsplit(u).scheme in ("http", "https")]


def modified(headers: dict[str, str]):
    try:
        return parsedate_to_datetime(headers["last-modified"])
    except (KeyError, ValueError, TypeError):
        return None


def fetch_once(url: str, seen: dict, fetch: Fetch, headers: dict[str, str] | None = None) -> tuple | None:
    """A row if the page is new or changed. seen: etag, last_modified (as sent) and hash of the fetch before."""
    asked = {"User-Agent": AGENT} | (headers or {})
    if seen.get("etag"):
        asked["If-None-Match"] = seen["etag"]
    if seen.get("last_modified"):
        asked["If-Modified-Since"] = seen["last_modified"]
    try:
        status, got, body = fetch(url, asked)
    except OSError as e:
        return url, 0, 0, None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:500]
    if status == 304:
        return None
    if status >= 400:
        return url, 0, status, None, None, None, None, None, None, f"status {status}"
    digest = hashlib.sha256(body).hexdigest()
    if digest == seen.get("hash"):
        return None
    return url, 0, status, "modify" if seen.get("hash") else "add", digest, body, got.get("content-type"), got.get("etag"), modified(got), None


def crawl(root: str, fetch: Fetch, max_depth: int = 3, max_pages: int = 500, same_origin: bool = True, robots: bool = True, rate_limit: str = "1/s", seen: dict[str, str] | None = None, sleep: Callable[[float], None] = time.sleep) -> Iterator[tuple]:
    """Rows of the pages that are new or changed since `seen` (url: hash), first in first out; only these count against max_pages."""
    if not 0 <= max_depth <= MAX_DEPTH or not 1 <= max_pages <= MAX_PAGES:
        raise ValueError(f"max_depth is 0 to {MAX_DEPTH}, max_pages 1 to {MAX_PAGES}")
    seen, start, spacing = dict(seen or {}), canonical(root), request_spacing(rate_limit)
    rules = urllib.robotparser.RobotFileParser()
    rules.parse([])
    if robots:
        try:
            status, _, body = fetch(origin(start) + "/robots.txt", {"User-Agent": AGENT})
            rules.parse(body.decode("utf-8", "replace").splitlines() if status < 400 else [])
        except OSError:
            pass
    waiting, visited, emitted, last = deque([(start, 0)]), set(), 0, None
    while waiting and emitted < max_pages:
        url, depth = waiting.popleft()
        if url in visited:
            continue
        visited.add(url)
        if same_origin and origin(url) != origin(start) or robots and not rules.can_fetch(AGENT, url):
            continue
        if last is not None:
            sleep(max(0.0, last + spacing - time.monotonic()))
        last = time.monotonic()
        try:
            status, got, body = fetch(url, {"User-Agent": AGENT})
        except OSError as e:
            yield url, depth, 0, None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:500]
            continue
        if status >= 400:
            continue
        digest, mime = hashlib.sha256(body).hexdigest(), got.get("content-type", "")
        if seen.get(url) != digest:
            yield url, depth, status, "modify" if url in seen else "add", digest, body, mime or None, got.get("etag"), modified(got), None
            seen[url] = digest
            emitted += 1
        if depth < max_depth and "html" in mime.lower():
            waiting.extend((c, depth + 1) for c in map(canonical, links(body, url)) if c not in visited)


@dataclass
class Site(InputPartition):
    url: str


class WebReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.o = dict(options)
        self.urls = [u for u in re.split(r"[\s,]+", self.o.get("urls", "")) if u]

    def partitions(self) -> list[InputPartition]:
        return [Site(u) for u in dict.fromkeys(self.urls)]

    def read(self, partition: Site) -> Iterator[tuple]:
        seen = json.loads(self.o.get("seen", "{}"))
        if self.o.get("mode", "single") == "single":
            row = fetch_once(partition.url, seen.get(partition.url, {}), http_fetch, json.loads(self.o.get("headers", "{}")))
            if row:
                yield row
        else:
            flag = lambda k: self.o.get(k, "true").lower() == "true"
            yield from crawl(partition.url, http_fetch, int(self.o.get("maxDepth", 3)), int(self.o.get("maxPages", 500)), flag("sameOrigin"), flag("robots"), self.o.get("rateLimit", "1/s"), seen)


class WebSource(DataSource):
    """spark.read.format("web").option("urls", ...).option("mode", "single" or "deep").load()"""

    @classmethod
    def name(cls) -> str:
        return "web"

    def schema(self) -> StructType | str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WebReader(self.options)
