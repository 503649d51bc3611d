import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import hashing, text, urls, vectors
from tessera.operators import similarity


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("HTTPS://Example.COM:443/a//b/?utm_source=x&b=2&a=1#frag", "https://example.com/a/b?a=1&b=2"),
        ("http://example.com:8080", "http://example.com:8080/"),
        ("http://x.org/p?a=1&a=2", "http://x.org/p?a=1&a=1"),
        ("http://x.org/?q=a%20b+c&FBCLID=9", "http://x.org/?q=a+b+c"),
        ("http://x.org?z", "http://x.org/?z="),
        ("ftp://x.org/", None),
        ("nonsense", None),
        ("", None),
    ],
)
def test_normalize_url(spark, given, want):
    assert one(spark, urls.normalize_url(F.col("u")), u=given) == want


def test_urls(spark):
    assert one(spark, urls.display_link(F.col("u")), u="https://u@Host.ORG:81/p") == "host.org"
    assert one(spark, urls.display_link(F.col("u")), u="x") == ""
    assert one(spark, urls.is_http_url(F.col("u")), u="https://h") is True and one(spark, urls.is_http_url(F.col("u")), u="mailto:a") is False


def test_hashes(spark):
    assert one(spark, hashing.content_hash(F.col("t")), t="abc") == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    assert one(spark, hashing.chunk_id(F.lit("u"), F.array(F.lit("a"), F.lit("b")), F.col("t")), t="x") == hashing.chunk_id_of("u", ["a", "b"], "x")


def test_lengths_and_tokens(spark):
    assert one(spark, text.js_length(F.col("t")), t="a😀") == 3
    assert one(spark, text.token_estimate(F.col("t")), t="abcde") == 2
    assert one(spark, text.block_token_estimate(F.col("t"), F.lit("code")), t="a" * 10) == 4
    assert one(spark, text.squeeze(F.col("t")), t="  a ﻿\n b ") == "a b"
    assert one(spark, text.split_word_count(F.col("t")), t="") == 1


def test_clean_html(spark):
    html = "<html><head><title>T</title></head><body><p>a &amp; <b>b</b></p><SCRIPT>x</p>\n</SCRIPT><img src=x>c<frameset>q</frameset></body></html>"
    assert one(spark, text.clean_html(F.col("h")), h=html) == "a &amp; b c q"
    assert one(spark, text.html_title(F.col("h")), h=html) == "T"
    assert one(spark, text.html_title(F.col("h")), h="<title>a\nb</title>") is None
    assert one(spark, text.clean_rendered_css(F.col("t")), t=".a { b: c } text @media x; #id{} more") == "text more"
    assert one(spark, text.split_camel_case(F.col("t")), t="oneTwo ωΑ3B") == "one Two ω Α3 B"


def test_excerpt_and_structure(spark):
    assert one(spark, text.excerpt(F.col("t"), 4), t="ab  cd") == "ab..."
    assert one(spark, text.excerpt(F.col("t"), 4), t="") is None
    assert one(spark, text.is_structural(F.col("t")), t="# H\n- a\n```\nx\n```") is True
    assert one(spark, text.is_structural(F.col("t")), t="Prose of a paragraph.") is False
    assert one(spark, text.first_sentence(F.col("t")), t="One! Two") == "One!"


def test_vectors(spark):
    a, b = [3.0, 4.0, 0.0], [1.0, 2.0, 2.0]
    row = spark.createDataFrame([(a, b, [0.0, 0.0, 0.0])], "a array<float>, b array<float>, z array<float>")
    got = row.select(vectors.cosine(F.col("a"), F.col("b")).alias("c"), vectors.l2(F.col("a"), F.col("b")).alias("d"), vectors.cosine(F.col("a"), F.col("z")).alias("n")).first()
    assert got.c == pytest.approx(11 / 15) and got.d == pytest.approx(math.sqrt(4 + 4 + 4)) and got.n is None
    with pytest.raises(Exception, match="dimension"):
        row.select(vectors.checked(F.col("a"), 2)).collect()


def test_search_order_limit_threshold(spark):
    q = spark.createDataFrame([(1, "u", [1.0, 0.0]), (2, "u", [1.0, 0.0])], "query_id long, url string, query_embedding array<float>")
    c = spark.createDataFrame([("far", "u", [10.0, 0.0]), ("near", "u", [1.0, 0.6]), ("mid", "u", [0.5, 0.5]), ("zero", "u", [0.0, 0.0]), ("other", "v", [1.0, 0.0])], "id string, url string, embedding array<float>")
    found = similarity.search(q, c, 3, 0.6)
    for i in (1, 2):  # equal queries each have their rows; the best cosine is beyond the limit
        assert [r.id for r in found.filter(F.col("query_id") == i).orderBy("rank").collect()] == ["near", "mid"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan


def test_queries_and_keywords(spark):
    clean = lambda v: one(spark, similarity.clean_queries(F.from_json(F.col("q"), "array<string>")), q=v)
    assert clean('["", " ", "a", null, "\\t"]') == ["a"] and clean("[]") == [] and one(spark, similarity.clean_queries(F.lit(None).cast("array<string>")), q="") == []
    match = lambda t, q, **k: one(spark, similarity.keyword_match(F.col("t"), F.col("q"), **k), t=t, q=q)
    assert match("The River", "x RIVER") is True and match("abc", "x y ") is False and match("abc", "x y ", trimmed=False) is True
