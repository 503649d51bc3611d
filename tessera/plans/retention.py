"""What a retention period removes, as semi and anti joins on the url."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Estimated bytes of a document and of a chunk.
DOCUMENT_BYTES, CHUNK_BYTES = 1000, 500


def expired(documents: DataFrame, cutoff) -> DataFrame:
    """Crawled strictly before the cutoff; a document without a crawl time never expires."""
    return documents.filter(F.col("last_crawled") < cutoff)


def dry_run(documents: DataFrame, chunks: DataFrame, cutoff) -> DataFrame:
    """One row: documents, chunks, bytes_saved."""
    old = expired(documents, cutoff).select("url")
    d = old.agg(F.count("*").alias("documents"))
    c = chunks.join(old, "url", "left_semi").agg(F.count("*").alias("chunks"))
    both = d.select("documents", F.lit(0).cast("long").alias("chunks")).unionByName(c.select(F.lit(0).cast("long").alias("documents"), "chunks"))
    out = both.agg(F.sum("documents").alias("documents"), F.sum("chunks").alias("chunks"))
    return out.withColumn("bytes_saved", F.col("documents") * DOCUMENT_BYTES + F.col("chunks") * CHUNK_BYTES)


def survivors(documents: DataFrame, chunks: DataFrame, cutoff) -> tuple[DataFrame, DataFrame]:
    """Both tables without what expired. Chunks without a document stay."""
    old = expired(documents, cutoff).select("url")
    return documents.join(old, "url", "left_anti"), chunks.join(old, "url", "left_anti")
