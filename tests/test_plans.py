import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.plans import catalog, read_page
from tessera.plans import web_search as ws
from tessera.sources.embeddings import HashProvider

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 9))
    return str(list(v)) if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    if name in catalog.ORACLES:
        sql = f"SELECT {', '.join(columns)} FROM ({catalog.ORACLES[name]})"
        assert got == sorted(tuple(map(plain, r)) for r in duck.execute(sql).fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


PAGE = "<html><body><main><h1>{0}</h1><p>{1}</p></main></body></html>"


def test_page_to_answers(spark):
    texts = {"a": "Rivers carry water to the sea. " * 30, "b": "Bread is made of flour and yeast. " * 30}
    pages = spark.createDataFrame([(f"HTTP://X.org/{k}/?utm_source=1", PAGE.format(k, t)) for k, t in texts.items()] + [("bad url", "x")], "url string, html string")
    documents, chunks = read_page.ingest(pages, HashProvider(), 60)
    chunks = chunks.cache()
    assert {r.url for r in documents.collect()} == {"http://x.org/a", "http://x.org/b"}
    assert chunks.filter("error is not null").count() == 0
    queries = spark.createDataFrame([(1, "http://x.org/a", "rivers carry water"), (2, "http://x.org/b", " "), (3, "http://x.org/b", "flour and yeast"), (4, "http://x.org/b", "flour and yeast")], "query_id long, url string, query string")
    got = read_page.answer(queries, chunks, HashProvider(), threshold=0.1)
    assert {r.query_id for r in got.collect()} == {1, 3, 4}
    words = read_page.keyword_answer(queries, chunks)
    assert {(r.query_id, r.score) for r in words.collect()} == {(1, 0.5), (3, 0.5), (4, 0.5)}
    refs = read_page.references(got, documents.select("url", F.lit(None).cast("timestamp").alias("last_crawled")))
    assert all(r.relevant_chunks and r.last_crawled for r in refs.collect())


def test_only_changed_pages_are_parsed(spark):
    pages = spark.createDataFrame([("u1", "h", "e1"), ("u2", "h", "new"), ("u3", "h", None)], "url string, html string, etag string")
    stored = spark.createDataFrame([("u1", "e1"), ("u2", "old")], "url string, etag string")
    assert {r.url for r in read_page.changed_pages(pages, stored).collect()} == {"u2", "u3"}


def test_web_search_keeps_all_items(spark):
    items = spark.createDataFrame([(1, 0, "ftp://no"), (1, 1, "http://x.org/a"), (1, 2, "http://x.org/a#again"), (1, 3, "http://x.org/b")], "query_id long, ordinal int, link string")
    queries = spark.createDataFrame([(1, "rivers carry water")], "query_id long, query string")
    pages = spark.createDataFrame([(f"http://x.org/{k}", PAGE.format(k, "Rivers carry water to the sea. " * 30)) for k in "ab"], "url string, html string")
    out = {r.ordinal: r.relevant_chunks for r in ws.web_search(items, queries, pages, HashProvider(), threshold=0.1).collect()}
    assert sorted(out) == [0, 1, 2, 3] and out[0] is None and out[1] and out[2] and out[3] is None


def test_result_limits(spark):
    import pytest

    from tessera.errors import ValidationError
    from tessera.operators.consolidation import consolidate_results
    from tessera.plans import read_page

    rows = spark.createDataFrame([(1, "u", i, f"i{i}", f"text number {i} " * 3, 1.0 - i / 100, f"s{i}") for i in range(60)], "query_id long, url string, rank int, id string, text string, score double, section_path string")
    assert consolidate_results(rows, most=7).count() == 7 and consolidate_results(rows).count() == 50
    for k in (0, 51, -1, "8", True):
        with pytest.raises(ValidationError):
            read_page.keyword_answer(rows, rows, k)
        with pytest.raises(ValidationError):
            read_page.answer(rows, rows, None, k)
