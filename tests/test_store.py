import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.errors import ConfigurationError, StoreError
from tessera.plans import retention, stats
from tessera.sources import store as st
from tessera.sources.embeddings import HashProvider
from tessera.sources.store import Store


def docs(spark, *rows):
    full = [(u, t, e, None, dt.datetime(2024, 1, day) if day else None, h) for u, t, e, day, h in rows]
    return spark.createDataFrame(full, st.DOCUMENTS)


def chunks(spark, *rows):
    schema = "id string, url string, section_path string, text string, tokens int, embedding array<float>, chunk_index int"
    return spark.createDataFrame([(i, u, None, f"text {i}", n, [1.0, 0.0, 0.5], k) for k, (i, u, n) in enumerate(rows)], schema)


def test_upsert_delete_and_reopen(spark, tmp_path):
    s = Store(spark, str(tmp_path), "Model A/1", 3)
    assert s.documents.count() == 0 and s.root.endswith("model=model-a-1")
    s.upsert_documents(docs(spark, ("u1", "one", "e1", 1, "h"), ("u2", "two", None, 2, "h")))
    s.upsert_documents(docs(spark, ("u1", None, "e9", 3, "h2")))
    assert [(r.url, r.title, r.etag) for r in s.documents.orderBy("url").collect()] == [("u1", None, "e9"), ("u2", "two", None)]
    s.upsert_chunks(chunks(spark, ("a", "u1", 5), ("b", "u1", 7), ("c", "u2", 1)))
    first = {r.id: r.created_at for r in s.chunks.collect()}
    s.upsert_chunks(chunks(spark, ("b", "u1", 70)))
    again = {r.id: (r.created_at, r.tokens) for r in s.chunks.collect()}
    assert again["b"] == (first["b"], 70) and len(again) == 3  # stale chunks stay, known times stay
    s.upsert_chunks(chunks(spark, ("z", "u1", 2)), replace=True)
    assert sorted(r.id for r in s.chunks.collect()) == ["c", "z"]
    s.upsert_chunks(chunks(spark, ("q", "u9", 1)).limit(0))
    s.delete_chunk("z")
    s.delete_document("u2")
    reopened = Store(spark, str(tmp_path), "Model A/1", 3)
    assert reopened.chunks.count() == 0 and [r.url for r in reopened.documents.collect()] == ["u1"]
    reopened.compact()
    assert reopened.document("u1").count() == 1 and reopened.size_bytes() > 0
    assert {n for n, _, _ in reopened.tables()} == {"chunks", "documents", "meta"}


def test_configuration(spark, tmp_path):
    s = Store(spark, str(tmp_path), "m", 3)
    s.upsert_chunks(chunks(spark, ("a", "u", 1)))
    with pytest.raises(StoreError):
        s.upsert_chunks(chunks(spark, ("b", "u", 1)).withColumn("embedding", F.array(F.lit(1.0).cast("float"))))
    assert Store(spark, str(tmp_path), "m", 3).chunks.count() == 1
    assert Store(spark, str(tmp_path), "m", 4).chunks.count() == 0  # another dimension empties the chunks
    with pytest.raises(ConfigurationError):
        s._write("meta", spark.createDataFrame([("embedding_model", "other")], st.META), st.META)
        Store(spark, str(tmp_path), "m", 3)


def test_retention_goldens(spark, tmp_path):
    d = docs(spark, ("u1", "a", None, 1, "h"), ("u2", "b", None, 2, "h"), ("u3", "c", None, 20, "h"), ("u4", "d", None, None, "h"))
    c = chunks(spark, *[(f"c{i}", "u1" if i < 3 else "u2", 1) for i in range(5)], ("k", "u3", 1), ("o", "orphan", 1))
    cut = F.lit(dt.datetime(2024, 1, 10))
    assert retention.dry_run(d, c, cut).first().asDict() == {"documents": 2, "chunks": 5, "bytes_saved": 4500}
    left, kept = retention.survivors(d, c, cut)
    assert {r.url for r in left.collect()} == {"u3", "u4"} and {r.id for r in kept.collect()} == {"k", "o"}
    s = Store(spark, str(tmp_path), "m", 3)
    s.upsert_documents(d)
    s.upsert_chunks(c)
    assert s.delete_expired(cut)["documents"] == 2 and s.chunks.count() == 2 and s.documents.count() == 2
    assert s.delete_expired(cut) == {"documents": 0, "chunks": 0, "bytes_saved": 0}


def test_statistics_goldens(spark):
    d = docs(spark, *[(f"u{i}", None, None, 1 + i, "h") for i in range(5)])
    c = chunks(spark, *[(f"c{i}", f"u{i % 4}", 10) for i in range(15)])
    meta = spark.createDataFrame([("embedding_model", "m"), ("embedding_dim", "3")], st.META)
    r = stats.store_stats(d, c, meta).first()
    assert (r.documents, r.chunks, r.estimated_bytes, r.embedding_dim) == (5, 15, 12500, "3")
    assert (stats.table_bytes(5, 8), stats.table_bytes(15, 9)) == (2000, 6750)
    per = {x.url: (x.chunk_count, x.total_tokens) for x in stats.per_document(d, c).collect()}
    assert per["u4"] == (0, 0) and per["u0"] == (4, 40)
    vectors = spark.createDataFrame([([3.0, 1.0],), ([2.0, 9.0],)], "embedding array<float>")
    m = stats.component_report(vectors).first()
    assert (m.n, m.least, m.greatest, m["mean"], m.median) == (4, 1.0, 9.0, 3.75, 3.0)
    assert stats.component_report(vectors.limit(0)).first().n == 0


def test_refresh(spark):
    old = docs(spark, ("u1", "t", "e", 1, "old"), ("u2", "t", "e", 1, "old"))
    fetched = spark.createDataFrame([("u1", 304, None, None, None), ("u2", 200, "body", None, "lm"), ("u3", 200, "b", "x", None)], "url string, status int, body string, etag string, last_modified string").withColumn("fetched_at", F.lit(dt.datetime(2024, 2, 1)))
    got = {r.url: r for r in st.refreshed(old, fetched).collect()}
    assert (got["u1"].content_hash, got["u1"].etag, got["u1"].title) == ("old", "e", "t")
    assert got["u2"].etag == "e" and got["u2"].last_modified == "lm" and len(got["u2"].content_hash) == 64
    assert got["u3"].title is None and all(r.last_crawled.month == 2 for r in got.values())


def test_stream(spark, tmp_path):
    from tessera.streaming.ingest import start

    s = Store(spark, str(tmp_path / "store"), "local-hash", 64)
    page = lambda n: f"<html><body><main><h1>Title {n}</h1><p>{'Some words of page %d. ' % n * 20}</p></main></body></html>"
    rows = [(1, "http://x.org/a?utm_source=q", page(1)), (2, "http://x.org/b", page(2)), (3, "http://x.org/b", page(3))]
    spark.createDataFrame(rows[:2], "page_id long, url string, html string").write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        start(spark, str(tmp_path / "in"), s, HashProvider(), str(tmp_path / "ck"), once=True).awaitTermination()
    assert sorted(r.url for r in s.documents.collect()) == ["http://x.org/a", "http://x.org/b"]
    spark.createDataFrame(rows[2:], "page_id long, url string, html string").write.mode("append").parquet(str(tmp_path / "in"))
    start(spark, str(tmp_path / "in"), s, HashProvider(), str(tmp_path / "ck"), once=True).awaitTermination()
    assert "page 3" in s.chunks_of("http://x.org/b").first().text and s.documents.count() == 2


def test_one_row_a_key(spark, tmp_path):
    s = Store(spark, str(tmp_path), "m", 3)
    s.upsert_documents(docs(spark, ("u1", "early", None, 1, "h"), ("u1", "late", None, 9, "h")))
    s.upsert_chunks(chunks(spark, ("a", "u1", 1), ("a", "u1", 2)))
    assert [r.title for r in s.documents.collect()] == ["late"] and s.chunks.count() == 1


def test_input_is_evaluated_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def paid(frames):
        for f in frames:
            calls.add(len(f))
            yield f

    rows = chunks(spark, *[(f"c{i}", "u1", 1) for i in range(10)])
    Store(spark, str(tmp_path), "m", 3).upsert_chunks(rows.mapInPandas(paid, rows.schema), replace=True)
    assert calls.value == 10


def test_pointer_and_old_plans(spark, tmp_path):
    s = Store(spark, str(tmp_path), "m", 3)
    s.upsert_documents(docs(spark, ("u1", "a", None, 1, "h")))
    before = s.documents
    s.upsert_documents(docs(spark, ("u1", "b", None, 2, "h")))
    assert [r.title for r in before.collect()] == ["a"] and [r.title for r in s.documents.collect()] == ["b"]
    pointer = next((tmp_path / "model=m" / "documents").glob("CURRENT"))
    for text in ("", "{"):
        pointer.write_text(text)
        (pointer.parent / ".CURRENT.crc").unlink(missing_ok=True)
        with pytest.raises(StoreError):
            s.documents.count()


def test_a_write_costs_what_it_changes(spark, tmp_path):
    s = Store(spark, str(tmp_path), "m", 3)
    s.upsert_documents(docs(spark, *[(f"u{i}", "t", None, 1, "h") for i in range(300)]))
    first = s._state("documents")["folders"]
    s.upsert_documents(docs(spark, ("u7", "new", None, 2, "h")))
    second = s._state("documents")["folders"]
    assert len(first) > 50 and sum(first[b] != second[b] for b in first) == 1
    assert s.documents.count() == 300 and s.document("u7").first().title == "new"
    s.delete_document("u8")
    assert s.documents.count() == 299
    s.compact()
    assert s.documents.count() == 299 and s._state("documents")["old"] == []


def test_median_with_outliers(spark, monkeypatch):
    import random

    monkeypatch.setattr(stats, "FEW", 50)
    rng = random.Random(3)
    for values in ([rng.gauss(0, 1) for _ in range(3000)] + [1e300, -1e12], [5.0] * 400 + [1e9], [0.0, 1.0] * 300, [1e-300 * rng.random() for _ in range(500)] + [1.0]):
        frame = spark.createDataFrame([(values[i : i + 10],) for i in range(0, len(values), 10)], "embedding array<double>")
        assert stats.component_report(frame).first().median == sorted(values)[len(values) // 2]
