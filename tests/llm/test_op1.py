import hashlib
import math
import re

import pytest

from tessera.llm import op1_url


def parts(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url) if url else None
    return (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")


def grams(url, buckets):
    out = []
    for tag, text in zip("hp", parts(url)):
        text = re.sub("[0-9]", "0", f"^{text}$")
        for n in op1_url.GRAMS:
            for i in range(max(len(text) - n + 1, 1)):
                out.append(int(hashlib.md5(f"{tag}{n}{text[i:i + n]}".encode()).hexdigest()[:8], 16) % buckets)
    return sorted(set(out))


def train(rows, buckets, steps):
    w, fs = [0.0] * (buckets + 1), [(y, grams(u, buckets)) for u, y in rows]
    for _ in range(steps):
        errs = [(y - 1 / (1 + math.exp(-(w[-1] + sum(w[b] for b in f) / math.sqrt(len(f))))), f) for y, f in fs]
        new = [x * (1 - op1_url.DECAY) for x in w[:-1]] + [w[-1] + op1_url.RATE * sum(e for e, _ in errs) / len(errs)]
        for e, f in errs:
            for b in f:
                new[b] += op1_url.RATE * e / math.sqrt(len(f))
        w = new
    return w


def test_fit_equals_plain_gradient_descent(spark):
    rows = [(u, 0) for u in op1_url.ALLOWED[:15]] + [(u, 1) for u in op1_url.BLOCKED[:15]]
    df = spark.createDataFrame([*rows, (None, 1), ("http://x", None)], "url string, label int")
    got = op1_url.fit(df, buckets=64, steps=5)
    assert got == pytest.approx(train(rows, 64, 5), abs=1e-9)


def test_fit_without_rows(spark):
    assert op1_url.fit(spark.createDataFrame([], "url string, label int"), buckets=8, steps=2) == [0.0] * 9


def test_verdicts(spark):
    weights = op1_url.fit(op1_url.labelled_urls(spark))
    urls = [
        None, "", "no scheme/com/en/", "http://", "HTTP://Example.COM/en/7x", "http://com/en/", "http://xcom/en/", "a://b.com/en/?q", "a://b.com/en",
        "x://é.net/de/1#t", "x://example.net/de/81", "x://q.org/es/", "x://org?/es/", "y://casino-bonus.win/free-spins", "y://library.org/catalogue", "z://a://b/c", "http://x.com/en/\n2",
    ]
    df = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(urls)] * 2 + [(None, "http://h/p", "h", 1)], "page_id long, url string, host string, rule int")
    got = op1_url.judge(df, weights).collect()
    assert len(got) == 2 * len(urls) + 1
    for r in got:
        url = urls[r.page_id] if r.page_id is not None else "http://h/p"
        host, path = parts(url)
        fits = [(len(x), x, v) for v, x in op1_url.RULES if (host == x.split("/")[0] or host.endswith("." + x.split("/")[0])) and path.startswith(x[len(x.split("/")[0]) :])]
        f = grams(url, op1_url.BUCKETS)
        p = 1 / (1 + math.exp(-(weights[-1] + sum(weights[b] for b in f) / math.sqrt(len(f)))))
        assert (r.host, r.path) == (host, path)
        assert r.block_probability == pytest.approx(p, abs=1e-8)
        assert (r.rule, r.verdict) == (max(fits)[1:] if fits else (None, "block" if p >= 0.5 else "allow"))


def test_empty(spark):
    assert op1_url.judge(spark.createDataFrame([], "page_id long, url string"), [0.0, 0.0]).count() == 0
