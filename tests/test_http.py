import datetime as dt
import gzip
import json
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.__main__ import main
from tessera.config import Settings, from_environment
from tessera.errors import ConfigurationError, NetworkError, ValidationError
from tessera.plans import envelope
from tessera.sources import http
from tessera.sources import store as st
from tessera.sources.store import Store


def site(method, url, headers, body, timeout):
    if url.endswith("/moved"):
        return 302, {"location": "/page"}, b""
    if url.endswith("/loop"):
        return 302, {"location": "/loop"}, b""
    if url.endswith("/gone"):
        return 404, {}, b""
    if url.endswith("/zip"):
        return 200, {"content-encoding": "gzip"}, gzip.compress("zipped é".encode())
    if url.endswith("/deflate"):
        return 200, {"content-encoding": "deflate"}, zlib.compress(b"flat")[2:-4]
    if headers.get("if-none-match") == "e1":
        return 304, {"etag": "e1"}, b""
    return 200, {"etag": "e1", "last-modified": "lm"}, b"hello"


def test_fetch():
    get = lambda path, **k: http.fetch(f"http://h{path}", transport=site, **k)
    assert get("/moved")["body"] == "hello" and get("/page")["etag"] == "e1"
    assert get("/page", etag="e1") == {"status": 304, "body": "", "etag": "e1", "last_modified": None, "not_modified": True, "error": None}
    assert get("/zip")["body"] == "zipped é" and get("/deflate")["body"] == "flat"
    for path in ("/gone", "/loop"):
        with pytest.raises(NetworkError):
            get(path)
    with pytest.raises(ValidationError):
        http.fetch("ftp://h/x", transport=site)


def test_fetch_pages_and_partial_success(spark):
    def site(method, url, headers, body, timeout):
        if url.endswith("/gone"):
            return 404, {}, b""
        return (304, {}, b"") if headers.get("if-none-match") == "e1" else (200, {"etag": "e1"}, b"hello")

    asked = spark.createDataFrame([("http://h/a", None, None), ("http://h/b", "e1", None), ("http://h/gone", None, None), ("bad", None, None)], "url string, etag string, last_modified string")
    got = {r.url: r for r in http.require_some(http.fetch_pages(asked, transport=site)).collect()}
    assert (got["http://h/a"].body, got["http://h/b"].not_modified, got["http://h/gone"].status) == ("hello", True, None)
    assert "404" in got["http://h/gone"].error and got["bad"].error
    with pytest.raises(NetworkError):
        http.require_some(http.fetch_pages(asked.filter("url = 'bad'"), transport=site))


def test_search():
    calls = []

    def api(*replies):
        replies = list(replies)
        return lambda *a: (calls.append(a), replies.pop(0))[1]

    assert http.search("brave", {"q": "x"}, "k", transport=api((500, {}, b""), (200, {}, b"{}"))) == "{}"
    assert calls[0][1].endswith("?q=x") and calls[0][2]["X-Subscription-Token"] == "k" and len(calls) == 2
    http.search("tavily", {"query": "x", "max_results": "5"}, "k", transport=api((200, {}, b"{}")))
    assert json.loads(calls[-1][3])["max_results"] == 5 and calls[-1][2]["Authorization"] == "Bearer k"
    with pytest.raises(NetworkError):
        http.search("google", {"q": "x"}, "k", "cx", transport=api((429, {}, b"")))


def test_envelope(spark):
    requests = spark.createDataFrame([(1, "http://H/a?utm_source=1", "http://h/a", 10, "q1"), (1, "http://H/a?utm_source=1", "http://h/a", 11, "q2")], "request_id long, url_in string, url string, query_id long, query string")
    answers = spark.createDataFrame([(10, "http://h/a", 1, "i2", "t2", 0.5, None), (10, "http://h/a", 0, "i1", "t1", 0.9, "A > B")], "query_id long, url string, place int, id string, text string, score double, section_path string")
    documents = spark.createDataFrame([("http://h/a", "T", dt.datetime(2024, 1, 1), None)], "url string, title string, last_crawled timestamp, note string")
    out = json.loads(envelope.to_json(envelope.page_responses(requests, answers, documents)).first().json)
    assert out["url"] == "http://H/a?utm_source=1" and out["lastCrawled"].startswith("2024-01-01") and "note" not in out
    assert out["queries"] == [{"query": "q1", "results": [{"id": "i1", "text": "t1", "score": 0.9, "sectionPath": ["A > B"]}, {"id": "i2", "text": "t2", "score": 0.5}]}, {"query": "q2", "results": []}]
    chunks = spark.createDataFrame([("http://h/a", "down")], "url string, error string")
    assert "down" in envelope.with_embedding_notes(documents, chunks).first().note


def test_settings():
    good = {"EMBEDDING_SERVER_URL": "http://e", "EMBEDDING_SERVER_API_KEY": "k", "EMBEDDING_MODEL_NAME": "m", "SEARCH_PROVIDER": "duckduckgo"}
    assert from_environment(good) == Settings("http://e", "k", "m", search_provider="duckduckgo")
    assert from_environment(good | {"SIMILARITY_THRESHOLD": "0.2", "CONCURRENCY": "10"}).concurrency == 10
    for bad in ({"CONCURRENCY": "11"}, {"CONCURRENCY": "x"}, {"SIMILARITY_THRESHOLD": "2"}, {"EMBEDDING_BATCH_SIZE": "33"}, {"SEARCH_PROVIDER": "google"}, {"SEARCH_PROVIDER": "brave"}, {"SEARCH_PROVIDER": "z"}, {"EMBEDDING_SERVER_URL": "e"}):
        with pytest.raises(ConfigurationError):
            from_environment(good | bad)
    with pytest.raises(ConfigurationError):
        from_environment({})


def test_command_line(spark, tmp_path, capsys):
    s = Store(spark, str(tmp_path), "m", 3)
    s.upsert_documents(spark.createDataFrame([("u1", "t", None, None, dt.datetime(2020, 1, 1), "h")], st.DOCUMENTS))
    at = ["--root", str(tmp_path), "--model", "m"]
    assert main(["inspect", *at]) == 0 and "documents: 1" in capsys.readouterr().out
    assert main(["inspect", *at, "--tables"]) == 0 and main(["inspect", *at, "--url", "u1"]) == 0
    assert main(["cleanup", *at, "--dry-run"]) == 0 and s.documents.count() == 1
    assert main(["cleanup", *at, "--days", "-1"]) == 1
    assert main(["cleanup", *at, "--vacuum"]) == 0 and s.documents.count() == 0
    assert spark.range(1).select(F.lit(1)).count() == 1


def test_limiter_and_concurrency(spark):
    now, slept = [0.0], []
    limiter = http.Limiter(2, clock=lambda: now[0], sleep=slept.append)
    for _ in range(4):
        limiter.take()
    assert slept == [0.5, 1.0]
    now[0] = 10.0
    limiter.take()
    assert slept == [0.5, 1.0]

    import threading
    import time

    lock, seen = threading.Lock(), [0, 0]

    def work(x):
        with lock:
            seen[0] += 1
            seen[1] = max(seen)
        time.sleep(0.02)
        with lock:
            seen[0] -= 1
        return x

    assert http._at_once(work, range(12), 3, None) == list(range(12)) and seen[1] == 3

    def answers(method, url, headers, body, timeout):
        return (404, {}, b"") if url.endswith("/gone") else (304, {}, b"") if "if-none-match" in headers else (200, {}, b"x")

    requests = spark.createDataFrame([("http://h/page", None, None), ("http://h/gone", None, None), ("http://h/page", "e1", None)], "url string, etag string, last_modified string").coalesce(1)
    assert [(r.status, r.not_modified, r.error is None) for r in http.fetch_pages(requests, transport=answers, concurrency=3).collect()] == [(200, False, True), (None, False, False), (304, True, True)]
