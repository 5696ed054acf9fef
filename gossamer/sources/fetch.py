"""Live pages: a pluggable fetcher, run per partition with its own rate limit.

The snapshot tables are the usual source; this one is for small frontiers only.  Requests are spread
over a set number of tasks, and each task keeps to its share of the rate, so the whole job keeps to
the rate as given.
"""

from __future__ import annotations

import http.cookiejar
import ssl
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

#: Sent where no other user agent is set.
USER_AGENT = "Mozilla/5.0 (compatible; gossamer/1)"
Fetched = tuple[int | None, dict[str, str], str | None, str | None, str | None]
SCHEMA = "url string, status_code int, headers map<string,string>, body string, redirect_to string, error string"


@dataclass(frozen=True)
class Limits:
    per_second: float = 150.0
    per_minute: float | None = None
    delay: float = 0.0
    timeout: float = 10.0
    retries: int = 1
    max_body: int = 4 * 1024 * 1024
    proxy: str | None = None
    headers: dict = field(default_factory=dict)
    cookies: bool = True  # kept per task, for its requests only
    verify_tls: bool = True


Getter = Callable[[str, str, "str | None", Limits], Fetched]


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *a):  # redirects are rows, not something to follow here
        return None


_jar = http.cookiejar.CookieJar()


def request_headers(limits: Limits) -> dict[str, str]:
    """The limits' headers; a user agent is always among them."""
    own = dict(limits.headers)
    if not any(k.lower() == "user-agent" for k in own):
        own["User-Agent"] = USER_AGENT
    return own


def http_get(method: str, url: str, body: str | None, limits: Limits) -> Fetched:
    """(status, headers, body, redirect target, error) of one request."""
    handlers: list = [_NoRedirect()]
    if limits.cookies:
        handlers.append(urllib.request.HTTPCookieProcessor(_jar))
    if not limits.verify_tls:
        handlers.append(urllib.request.HTTPSHandler(context=ssl._create_unverified_context()))
    if limits.proxy:
        handlers.append(urllib.request.ProxyHandler({"http": limits.proxy, "https": limits.proxy}))
    opener = urllib.request.build_opener(*handlers)
    req = urllib.request.Request(url, data=body.encode() if body is not None and method != "GET" else None, method=method or "GET", headers=request_headers(limits))
    try:
        with opener.open(req, timeout=limits.timeout) as r:
            return _read(r, limits)
    except urllib.error.HTTPError as r:
        return _read(r, limits)
    except (OSError, ValueError) as e:
        return None, {}, None, None, str(e)


def _read(r, limits: Limits) -> Fetched:
    heads: dict[str, str] = {}
    for k, v in r.headers.items():
        k = k.lower()
        heads[k] = f"{heads[k]};{v}" if k in heads else v
    text = r.read(limits.max_body).decode(r.headers.get_content_charset() or "utf-8", "replace")
    return r.status, heads, text, heads.get("location") if 300 <= r.status < 400 else None, None


class Bucket:
    """Waits so that no more than the given number of calls start in a span of time."""

    def __init__(self, limits: Limits, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep, share: float = 1.0):
        rate = (limits.per_second or (limits.per_minute or 0) / 60) * share
        self.gap, self.delay, self.next, self.clock, self.sleep = (1 / rate if rate else 0.0), limits.delay, 0.0, clock, sleep

    def take(self) -> None:
        now = self.clock()
        if now < self.next:
            self.sleep(self.next - now)
        self.next = max(now, self.next) + max(self.gap, self.delay)


def fetch(requests: DataFrame, limits: Limits = Limits(), get: Getter = http_get, tasks: int = 1) -> DataFrame:
    """(url, status_code, headers, body, redirect_to, error) of (url, method, body) requests, in so many tasks at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = Bucket(limits, share=1 / tasks)
        for b in batches:
            rows = []
            for url, method, body in zip(*(c.to_pylist() for c in b.columns)):
                got: Fetched = (None, {}, None, None, "no url")
                for _ in range(limits.retries + 1) if url else ():
                    bucket.take()
                    got = get(method or "GET", url, body, limits)
                    if got[4] is None:
                        break
                rows.append((url, got[0], list(got[1].items()), *got[2:]))
            kinds = [pa.string(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], ["url", "status_code", "headers", "body", "redirect_to", "error"])

    return requests.select("url", "method", "body").repartition(tasks, "url").mapInArrow(run, SCHEMA)
