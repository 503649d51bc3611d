import json

import pytest
from pyspark.sql import functions as F

from tessera.errors import ConfigurationError, EmbeddingError
from tessera.functions import misc
from tessera.sources import embeddings as em
from tessera.sources import providers as pr


def items(spark, provider, body, **options):
    df = spark.createDataFrame([(1, json.dumps(body))], "query_id long, body string")
    return [r.asDict(recursive=True) for r in pr.explode_items(df, provider, **options).orderBy("ordinal").collect()]


def test_google(spark):
    body = {"items": [{"title": "T", "link": "https://a.org/x", "mime": "m"}, {"title": "no link"}, {"title": "U", "link": "https://b.org/", "displayLink": "D", "snippet": "S", "formattedUrl": "F"}]}
    got = items(spark, "google", body)
    assert [(g["title"], g["display_link"], g["snippet"], g["formatted_url"]) for g in got] == [("T", "a.org", "", "https://a.org/x"), ("U", "D", "S", "F")]
    assert got[0]["extra"] == {"mime": "m"} and json.loads(got[0]["raw"])["mime"] == "m"


def test_brave(spark):
    body = {"web": {"results": [{"title": "T", "url": "https://a.org/x", "profile": {"name": ""}, "source": "src", "age": "", "page_age": "old"}, {"title": "", "url": "x"}]}, "news": {"results": [{"title": "N", "url": "https://n.org", "description": "d"}]}}
    got = items(spark, "brave", body)
    assert [(g["title"], g["display_link"], g["extra"].get("resultType"), g["extra"].get("age")) for g in got] == [("T", "src", "web", "old"), ("N", "n.org", "news", None)]


def test_tavily(spark):
    body = {"results": [{"title": "T", "url": "https://a.org", "content": "c", "score": 0.5}, {"url": "u"}], "response_time": "2.25"}
    got = items(spark, "tavily", body)
    assert len(got) == 1 and got[0]["snippet"] == "c" and got[0]["extra"] == {"score": "0.5"}
    df = spark.createDataFrame([(json.dumps(body),), ('{"response_time": 3}',), ("{}",)], "b string")
    assert [r[0] for r in df.select(pr.tavily_response_time(F.col("b"))).collect()] == [2.25, 3.0, None]


def test_duckduckgo(spark):
    body = {"Heading": "", "AbstractURL": "https://w.org/a", "AbstractText": "One. Two.", "Results": [{"FirstURL": "https://r.org", "Text": "R! more"}], "RelatedTopics": [{"Topics": [{"FirstURL": "https://n.org", "Text": "N"}, {"Topics": [{"FirstURL": "https://d.org", "Text": "D"}]}]}, {"FirstURL": "https://l.org", "Text": ""}]}
    assert [g["title"] for g in items(spark, "duckduckgo", body)] == ["One.", "R!", "N", "D"]
    assert [g["title"] for g in items(spark, "duckduckgo", body, limit=2)] == ["One.", "R!"]


def test_requests_and_registry(spark):
    df = spark.createDataFrame([("q", 99, "week", "news")], "q string, n int, r string, t string")
    got = {p: df.select(pr.request_parameters(p, F.col("q"), F.col("n"), F.col("r"), F.col("t"))).first()[0] for p in pr.ITEMS}
    assert got["google"] == {"q": "q", "num": "10", "dateRestrict": "w1"}
    assert got["brave"] == {"q": "q", "count": "20", "freshness": "pw", "result_filter": "news"}
    assert got["tavily"]["max_results"] == "20" and got["tavily"]["search_depth"] == "basic"
    with pytest.raises(ConfigurationError):
        pr.items_of("other")


def test_embedding_rules():
    sent = []

    def answer(*replies):
        replies = list(replies)
        return em.HttpProvider("http://h", "k", "m", send=lambda body: (sent.append(body), replies.pop(0))[1])

    good = {"data": [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}]}
    assert answer((200, good)).embed(["a", "b"]) == [[1.0], [2.0]]
    assert answer().embed([]) == []
    for reply in ({"data": [{"embedding": [1.0]}]}, {}, {"data": [{"embedding": 1}, {"embedding": [1]}]}):
        with pytest.raises(EmbeddingError):
            answer((200, reply)).embed(["a", "b"])
    with pytest.raises(EmbeddingError) as e:
        answer((429, {})).embed(["a"])
    assert e.value.retryable
    em.time.sleep, keep = lambda s: None, em.time.sleep
    try:
        assert answer((503, {}), (200, good)).embed(["a", "b"]) == [[1.0], [2.0]]
    finally:
        em.time.sleep = keep
    with pytest.raises(ConfigurationError):
        em.provider("local")


def test_embed_column_keeps_rows(spark):
    class Fails:
        model = "fails"

        def embed(self, texts):
            if any("bad" in t for t in texts):
                raise EmbeddingError("bad text", 500)
            return [[1.0, 2.0]] * len(texts)

    df = spark.createDataFrame([(i, "bad" if i == 9 else f"t{i}") for i in range(20)], "id long, text string").coalesce(1)
    got = em.embed_column(df, Fails(), batch=4).collect()
    assert len(got) == 20 and sum(r.embedding is None for r in got) == 4 and {r.error for r in got} == {None, "bad text (status 500)"}


def test_misc(spark):
    assert misc.model_directory("Org/Model 1.5!") == "org-model-1-5"
    assert [misc.format_bytes(n) for n in (0, 10, 1536, 3 << 20, 5 << 40)] == ["0 Bytes", "10 Bytes", "1.5 KB", "3 MB", "5120 GB"]
    assert misc.redact({"API_KEY": "x", "a": {"authorization": "y", "n": 1}}) == {"API_KEY": "[REDACTED]", "a": {"authorization": "[REDACTED]", "n": 1}}
    with pytest.raises(ValueError):
        misc.cutoff(F.current_timestamp(), -1)
