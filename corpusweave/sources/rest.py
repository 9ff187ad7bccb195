"""Python data sources over paged HTTP services; the fetch function is given, so tests run on recorded pages."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from corpusweave.sources.files import RECORD


class RateLimited(Exception):
    """The service asks to come back later."""


class SourceUnavailable(Exception):
    """The service does not answer."""


class RateLimiter:
    """Spaces calls of one process by `interval` seconds and remembers a service's cooldown."""

    def __init__(self, interval: float):
        self.interval, self._next, self._cool = interval, 0.0, 0.0

    def acquire(self, now: float | None = None) -> float:
        """Seconds to wait before the next call may go out."""
        now = time.monotonic() if now is None else now
        wait = max(0.0, self._next - now)
        self._next = max(self._next, now) + self.interval
        return wait

    def start_cooldown(self, seconds: float, now: float | None = None) -> None:
        self._cool = (time.monotonic() if now is None else now) + seconds

    def cooling_down(self, now: float | None = None) -> bool:
        return (time.monotonic() if now is None else now) < self._cool


def http_get(url: str, timeout: float = 30, tries: int = 4, wait: float = 3.0) -> str:
    """Body of an answer; busy answers and dropped connections are tried again after doubling waits."""
    for attempt in range(tries):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as answer:
                return answer.read().decode()
        except urllib.error.HTTPError as e:
            if e.code not in (429, 500, 502, 503, 504):
                raise SourceUnavailable(str(e)) from e
            pause = float(e.headers.get("Retry-After") or wait * 2**attempt)
            if e.code == 429 and attempt == tries - 1:
                raise RateLimited(str(e)) from e
        except (urllib.error.URLError, ConnectionError, TimeoutError):
            pause = wait * 2**attempt
        time.sleep(pause)
    raise SourceUnavailable(url)


class _Page(InputPartition):
    def __init__(self, url: str):
        self.url = url


class _Pages(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = json.loads(options["urls"])
        self.source = options.get("source", "rest")

    def partitions(self):
        return [_Page(u) for u in self.urls]

    def read(self, partition):
        if partition is None:
            return
        url = partition.url
        body = open(url[7:]).read() if url.startswith("file://") else http_get(url)
        for r in json.loads(body).get("results", []):
            text = lambda k: str(r.get(k) or "")
            whole = lambda k: int(r[k]) if r.get(k) is not None else None
            yield (self.source, text("source_id"), text("title"), text("abstract"), text("authors"), text("date"), whole("year"), text("doi"), text("arxiv_id"), text("venue"), text("primary_category"), whole("cited_by_count"), text("url"))


class RecordPages(DataSource):
    """`spark.read.format("record_pages").option("urls", json list)`: one partition per page, rows of the common shape."""

    @classmethod
    def name(cls):
        return "record_pages"

    def schema(self):
        return RECORD

    def reader(self, schema):
        return _Pages(self.options)


class _Harvest(SimpleDataSourceStreamReader):
    """Offset: how many pages have been taken. A restarted query goes on after the last committed page."""

    def __init__(self, options: dict):
        self.urls = json.loads(options["urls"])

    def initialOffset(self):
        return {"page": 0}

    def read(self, start):
        page = start["page"]
        if page >= len(self.urls):
            return iter([]), start
        url = self.urls[page]
        body = open(url[7:]).read() if url.startswith("file://") else http_get(url)
        return iter([(page, body)]), {"page": page + 1}

    def readBetweenOffsets(self, start, end):
        for page in range(start["page"], end["page"]):
            url = self.urls[page]
            yield page, open(url[7:]).read() if url.startswith("file://") else http_get(url)


class PageStream(DataSource):
    """`spark.readStream.format("page_stream")`: pages as (page, body), one a batch, resumed from the checkpoint."""

    @classmethod
    def name(cls):
        return "page_stream"

    def schema(self):
        return "page int, body string"

    def simpleStreamReader(self, schema):
        return _Harvest(self.options)


def register(spark) -> None:
    spark.dataSource.register(RecordPages)
    spark.dataSource.register(PageStream)


def search_url(base: str, phrases: list[str], cursor: int, limit: int, style: str) -> str:
    """Query string of a source's phrase search."""
    from urllib.parse import quote

    if style == "atom":
        q = " OR ".join(f'all:"{p}"' for p in phrases)
        return f"{base}?search_query={quote(q)}&start={cursor}&max_results={limit}"
    q = "|".join(f'"{p}"' for p in phrases) if style == "bar" else " OR ".join(f'"{p}"' for p in phrases)
    return f"{base}?query={quote(q)}&page={cursor // limit + 1}&limit={limit}"
