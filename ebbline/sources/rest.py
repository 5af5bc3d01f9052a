"""Paged REST extraction: a limiter, retries, a client, and a data source by page ranges."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

REQUIRED = ("event_id", "event_type")


class RateLimiter:
    """At most ``rate`` calls a second, by a least interval between them."""

    def __init__(self, rate: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.interval, self.clock, self.sleep, self.next_at = (1.0 / rate if rate > 0 else 0.0), clock, sleep, None

    def wait(self) -> None:
        now = self.clock()
        if self.next_at is not None and now < self.next_at:
            self.sleep(self.next_at - now)
            now = self.next_at
        self.next_at = now + self.interval


@dataclass
class Response:
    status: int
    body: Any = None
    headers: dict[str, str] = field(default_factory=dict)


def http_get(url: str, params: dict[str, Any], headers: dict[str, str] | None = None, timeout: float = 30.0) -> Response:
    full = f"{url}?{urllib.parse.urlencode(params)}" if params else url
    try:
        with urllib.request.urlopen(urllib.request.Request(full, headers=headers or {}), timeout=timeout) as r:
            return Response(r.status, json.loads(r.read() or b"null"), dict(r.headers))
    except urllib.error.HTTPError as e:
        return Response(e.code, None, dict(e.headers or {}))


def fetch_with_retry(get: Callable[[], Response], retries: int = 3, sleep: Callable[[float], None] = time.sleep) -> Response | None:
    """The first good response. 429 waits as told (5 s), 5xx and exceptions back off, other 4xx give None."""
    for attempt in range(retries + 1):
        wait = 2.0**attempt + 0.5
        try:
            r = get()
        except (OSError, ValueError):
            r = None
        if r is not None:
            if r.status < 400:
                return r
            if r.status == 429:
                told = r.headers.get("Retry-After", "5")
                wait = float(told) if told.replace(".", "", 1).isdigit() else 5.0
            elif r.status < 500:
                return None
        if attempt < retries:
            sleep(wait)
    return None


def retry_with_backoff(fn: Callable[[], Any], max_retries: int = 3, initial_backoff: float = 1.0, max_backoff: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> Any:
    """Calls ``fn`` until its result has a status below 500; then the result, else the last error."""
    backoff, last = initial_backoff, None
    for attempt in range(max_retries + 1):
        try:
            out = fn()
            if getattr(out, "status_code", getattr(out, "status", 200)) < 500:
                return out
            last = RuntimeError("server error")
        except Exception as e:  # noqa: BLE001
            last = e
        if attempt < max_retries:
            sleep(min(backoff, max_backoff))
            backoff *= 2
    raise last


def records_of(body: Any) -> list[dict] | None:
    """The records under ``data`` or ``results``; None if the shape is wrong."""
    if not isinstance(body, dict):
        return None
    found = body.get("data", body.get("results"))
    return found if isinstance(found, list) else None


def validate_records(body: Any, required: tuple[str, ...] = REQUIRED) -> tuple[list[dict], list[dict]]:
    """Valid records, and dead ones with ``_rejection_reason``."""
    good, dead = [], []
    for r in records_of(body) or []:
        missing = [k for k in required if not isinstance(r, dict) or r.get(k) in (None, "")]
        if missing:
            dead.append((r if isinstance(r, dict) else {"value": r}) | {"_rejection_reason": f"missing: {', '.join(missing)}"})
        else:
            good.append(r)
    return good, dead


def has_more(body: dict, n: int, page_size: int) -> bool:
    meta = body.get("pagination") or body.get("meta") or {}
    return bool(meta.get("has_more", n >= page_size))


@dataclass
class ExtractMetrics:
    pages: int = 0
    records: int = 0
    failed_pages: int = 0


class ApiExtractor:
    """Pages until there are no more, an error, or ``max_pages``."""

    def __init__(self, url: str, page_size: int = 1000, max_pages: int = 500, rate: float = 10.0, get: Callable[..., Response] = http_get, sleep: Callable[[float], None] = time.sleep):
        self.url, self.page_size, self.max_pages, self.get, self.sleep = url, page_size, max_pages, get, sleep
        self.limiter, self.metrics = RateLimiter(rate, sleep=sleep), ExtractMetrics()

    def page(self, number: int, params: dict[str, Any]) -> dict | None:
        self.limiter.wait()
        asked = {"page": number, "page_size": self.page_size} | params
        r = fetch_with_retry(lambda: self.get(self.url, asked), sleep=self.sleep)
        if r is None or records_of(r.body) is None:
            self.metrics.failed_pages += 1
            return None
        self.metrics.pages += 1
        return r.body

    def iterate(self, date: str | None = None, extra: dict[str, Any] | None = None, first: int = 1, last: int | None = None) -> Iterator[dict]:
        params = ({"date": date} if date else {}) | (extra or {})
        for number in range(first, min(last or self.max_pages, self.max_pages) + 1):
            body = self.page(number, params)
            if body is None:
                return
            rows = records_of(body)
            self.metrics.records += len(rows)
            yield from rows
            if not has_more(body, len(rows), self.page_size):
                return

    def extract(self, date: str | None = None, extra: dict[str, Any] | None = None) -> list[dict]:
        return list(self.iterate(date, extra))


@dataclass
class PageRange(InputPartition):
    first: int
    last: int


class RestPages(DataSource):
    """``spark.read.format("rest_pages")``: options url, pages, pages_per_task, page_size, date.

    Rows are (page, record as JSON); each task fetches a range of pages with its own limiter.
    """

    @classmethod
    def name(cls) -> str:
        return "rest_pages"

    def schema(self) -> str:
        return "page int, record string"

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(self.options)


class _PageReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self) -> list[PageRange]:
        pages, step = int(self.options.get("pages", "500")), int(self.options.get("pages_per_task", "50"))
        return [PageRange(a, min(a + step - 1, pages)) for a in range(1, pages + 1, step)]

    def read(self, partition: PageRange):
        rate = float(self.options.get("rate", "10"))
        client = ApiExtractor(self.options["url"], int(self.options.get("page_size", "1000")), partition.last, rate)
        params = {"date": self.options["date"]} if "date" in self.options else {}
        for number in range(partition.first, partition.last + 1):
            body = client.page(number, params)
            if body is None:  # the task is tried again; a part of the pages must not pass for all
                raise RuntimeError(f"page {number} of {self.options['url']} can't be read")
            rows = records_of(body)
            for r in rows:
                yield (number, json.dumps(r))
            if not has_more(body, len(rows), client.page_size):
                return
