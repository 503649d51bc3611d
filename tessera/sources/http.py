"""Live sources: pages and search answers over HTTP, ``concurrency`` connections and requests a second in a task.

A source is a function from a request to (status, headers, body). Tests and crawlers with their own
client pass one; the default is the standard library's. What fails is a row with an ``error``, so a
bad host doesn't end a job; ``require_some`` ends it if everything failed. Limits are a task's: the
number of tasks (``requests.coalesce(n)``) times ``concurrency`` is what an address sees at most.
"""

from __future__ import annotations

import gzip
import threading
import time
import urllib.error
import urllib.parse
import urllib.request
import zlib
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import NetworkError, ValidationError

TIMEOUT, REDIRECTS, CONCURRENCY = 20.0, 3, 2
REDIRECTED = (301, 302, 303, 307, 308)
PAGE_SCHEMA = "status int, body string, etag string, last_modified string, not_modified boolean, error string"

Send = Callable[[str, str, dict, bytes | None, float], tuple[int, dict, bytes]]


class Limiter:
    """A bucket of ``rate`` tokens that fills by ``rate`` a second; ``take`` waits for a token."""

    def __init__(self, rate: float, clock=time.monotonic, sleep=time.sleep):
        self.rate, self.clock, self.sleep = rate, clock, sleep
        self.held, self.at, self.lock = float(rate), clock(), threading.Lock()

    def take(self) -> None:
        with self.lock:
            now = self.clock()
            self.held = min(self.rate, self.held + (now - self.at) * self.rate) - 1
            self.at = now
            wait = max(0.0, -self.held / self.rate)
        if wait:
            self.sleep(wait)


def _at_once(work: Callable, items, concurrency: int, rate: float | None) -> list:
    """``work`` of each item, in order, ``concurrency`` at a time, each after a token if there's a ``rate``."""
    limiter = Limiter(rate) if rate else None

    def one(item):
        if limiter is not None:
            limiter.take()
        return work(item)

    with ThreadPoolExecutor(max(1, concurrency)) as pool:
        return list(pool.map(one, items))


class _Stay(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *_):
        return None


def send(method: str, url: str, headers: dict, body: bytes | None, timeout: float) -> tuple[int, dict, bytes]:
    """One request, redirects not followed; header names in lower case."""
    opener = urllib.request.build_opener(_Stay)
    try:
        with opener.open(urllib.request.Request(url, body, headers, method=method), timeout=timeout) as r:
            return r.status, {k.lower(): v for k, v in r.headers.items()}, r.read()
    except urllib.error.HTTPError as e:
        return e.code, {k.lower(): v for k, v in e.headers.items()}, e.read()


def decoded(headers: dict, body: bytes) -> str:
    kind = headers.get("content-encoding", "").lower()
    if kind == "gzip":
        body = gzip.decompress(body)
    elif kind == "deflate":
        try:
            body = zlib.decompress(body)
        except zlib.error:
            body = zlib.decompress(body, -zlib.MAX_WBITS)
    elif kind not in ("", "identity"):
        raise NetworkError(f"unsupported content encoding: {kind}")
    return body.decode("utf-8", "replace")


def fetch(url: str, etag: str | None = None, last_modified: str | None = None, timeout: float = TIMEOUT, transport: Send = send) -> dict:
    """A page, or that it hasn't changed. http and https only, three redirects at most."""
    headers = {"accept-encoding": "gzip, deflate", "accept": "text/html,*/*"}
    headers |= {"if-none-match": etag} if etag else {}
    headers |= {"if-modified-since": last_modified} if last_modified else {}
    for _ in range(REDIRECTS + 1):
        if not url.lower().startswith(("http://", "https://")):
            raise ValidationError(f"only http(s) URLs are supported: {url}")
        status, got, body = transport("GET", url, headers, None, timeout)
        if status in REDIRECTED and got.get("location"):
            url = urllib.parse.urljoin(url, got["location"])
            continue
        if status >= 400:
            raise NetworkError(f"request failed with status {status}")
        same = status == 304
        return {"status": status, "body": "" if same else decoded(got, body), "etag": got.get("etag"), "last_modified": got.get("last-modified"), "not_modified": same, "error": None}
    raise NetworkError(f"more than {REDIRECTS} redirects")


def fetch_pages(requests: DataFrame, timeout: float = TIMEOUT, transport: Send = send, concurrency: int = CONCURRENCY, rate: float | None = None) -> DataFrame:
    """Requests (url, etag, last_modified) with status, body, new validators, not_modified and error."""

    def one(r):
        text = lambda v: v if isinstance(v, str) else None
        try:
            return fetch(r.url, text(r.etag), text(r.last_modified), timeout, transport)
        except (NetworkError, ValidationError, OSError, ValueError, zlib.error, EOFError) as e:
            return {"status": None, "body": None, "etag": None, "last_modified": None, "not_modified": False, "error": str(e)}

    def run(frames):
        for f in frames:
            rows = _at_once(one, f.itertuples(), concurrency, rate)
            out = pd.DataFrame(rows, columns=["status", "body", "etag", "last_modified", "not_modified", "error"])
            out["status"] = out["status"].astype("Int32")
            out.insert(0, "url", f["url"].tolist())
            yield out

    return requests.select("url", "etag", "last_modified").mapInPandas(run, f"url string, {PAGE_SCHEMA}")


#: Addresses and authorisation headers of the providers.
ENDPOINTS = {
    "google": ("GET", "https://www.googleapis.com/customsearch/v1", None),
    "brave": ("GET", "https://api.search.brave.com/res/v1/web/search", "X-Subscription-Token"),
    "duckduckgo": ("GET", "https://api.duckduckgo.com/", None),
    "tavily": ("POST", "https://api.tavily.com/search", "Authorization"),
}


def search(provider: str, parameters: dict, key: str | None = None, engine: str | None = None, timeout: float = TIMEOUT, transport: Send = send) -> str:
    """The JSON text of one answer. Server errors are tried once more, client errors are not."""
    import json

    method, url, header = ENDPOINTS[provider]
    headers = {"accept": "application/json"}
    if header:
        headers[header] = f"Bearer {key}" if header == "Authorization" else str(key)
    body = None
    if provider == "google":
        parameters = parameters | {"key": key or "", "cx": engine or ""}
    if method == "POST":
        numbers = {k: int(v) if k == "max_results" else v for k, v in parameters.items()}
        headers["content-type"], body = "application/json", json.dumps(numbers).encode()
    else:
        url = f"{url}?{urllib.parse.urlencode(parameters)}"
    status, got, data = transport(method, url, headers, body, timeout)
    if status >= 500:
        status, got, data = transport(method, url, headers, body, timeout)
    if not 200 <= status < 300:
        raise NetworkError(f"{provider} request failed with status {status}")
    return decoded(got, data)


def search_answers(requests: DataFrame, provider: str, key: str | None = None, engine: str | None = None, timeout: float = TIMEOUT, transport: Send = send, concurrency: int = CONCURRENCY) -> DataFrame:
    """(query_id, body, error) of (query_id, parameters map)."""
    kind = requests.schema["query_id"].dataType.simpleString()

    def one(p):
        try:
            return search(provider, dict(p), key, engine, timeout, transport), None
        except (NetworkError, OSError, ValueError, zlib.error, EOFError) as e:
            return None, str(e)

    def run(frames):
        for f in frames:
            got = _at_once(one, f["parameters"], concurrency, concurrency)
            bodies, errors = [g[0] for g in got], [g[1] for g in got]
            yield pd.DataFrame({"query_id": f["query_id"], "body": pd.Series(bodies, index=f.index, dtype=object), "error": pd.Series(errors, index=f.index, dtype=object)})

    return requests.select("query_id", "parameters").mapInPandas(run, f"query_id {kind}, body string, error string")


def require_some(rows: DataFrame) -> DataFrame:
    """The rows, or an error if there are some and all of them failed."""
    r = rows.agg(F.count("*").alias("n"), F.count("error").alias("failed"), F.max("error").alias("last")).first()
    if r["n"] and r["n"] == r["failed"]:
        raise NetworkError(r["last"])
    return rows
