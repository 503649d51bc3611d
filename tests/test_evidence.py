"""The stated answers, and the queries over stand-ins, against their SQL."""

import duckdb
import pytest

from tessera.plans import catalog, evidence  # noqa: F401

SF = "/root/testdata/sf0.001"
NAMES = ["store_lifecycle", "store_guards", "http_pages", "embed_texts", "embedding_notes", "references", "limits_and_errors", "small_functions", "chunk_goldens", "consolidation_goldens", "extraction_goldens", "markdown_goldens", "response_envelope", "read_from_page_keywords", "chunk_overlap_stats"]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_equal_to_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rel = db.execute(catalog.ORACLES[name])
    given = [c[0] for c in rel.description]
    assert sorted(given) == columns
    plain = lambda row, names: tuple(repr(row[names.index(c)]) for c in columns)
    assert sorted(plain(tuple(r), df.columns) for r in df.collect()) == sorted(plain(r, given) for r in rel.fetchall())
