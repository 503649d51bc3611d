"""Continuous ingestion, an addition: pages that arrive in a directory go into the store, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.read_page import ingest
from ..sources.embeddings import EmbeddingProvider
from ..sources.store import Store, latest

PAGES = "page_id long, url string, html string"


def start(spark: SparkSession, pages_dir: str, store: Store, provider: EmbeddingProvider, checkpoint: str, schema: str = PAGES, once: bool = False):
    """A streaming query. Writes are keyed upserts, so a batch that runs again changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        own = latest(batch, "url", F.col("page_id").desc()).select("url", "html")
        documents, chunks = ingest(own, provider)
        store.upsert_chunks(chunks.filter("embedding is not null").drop("error"), replace=True)
        rows = documents.select("url", "title", F.lit(None).cast("string").alias("etag"), F.lit(None).cast("string").alias("last_modified"), F.current_timestamp().alias("last_crawled"), "content_hash")
        store.upsert_documents(rows)

    writer = spark.readStream.schema(schema).parquet(pages_dir).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
