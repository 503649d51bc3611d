"""Pages and queries to cited answers, for any number of pages and queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing, urls
from ..operators import similarity
from ..operators.chunking import chunk_documents, stored_path
from ..operators.consolidation import checked_limit, consolidate_results
from ..operators.extraction import extract_pages
from ..sources.embeddings import EmbeddingProvider, embed_column
from ..sources.store import revalidated

MOST_RESULTS, SEARCH_RESULTS = 8, 30


def changed_pages(pages: DataFrame, documents: DataFrame | None) -> DataFrame:
    """Pages (url, html, etag) that the store doesn't have unchanged: only these meet a parser or a model."""
    if documents is None:
        return pages
    state = revalidated(pages.select("url", "etag"), documents).filter("unchanged").select("url")
    return pages.join(state, "url", "left_anti")


def ingest(pages: DataFrame, provider: EmbeddingProvider, most_tokens: int = 512, overlap: float = 15, canonical: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, chunks) for the store from (url, html). Both are plans; each url is canonical.

    ``canonical``: the urls are so already, and each is there once.
    """
    if not canonical:
        pages = pages.withColumn("url", urls.normalize_url(F.col("url"))).filter("url is not null").dropDuplicates(["url"])
    found = extract_pages(pages)
    documents = found.select("url", "title", hashing.content_hash(F.col("text")).alias("content_hash"), "section_paths", "excerpt", "lang", "method", "note")
    chunks = chunk_documents(found.select("url", "markdown"), most_tokens, overlap)
    rows = chunks.select("id", "url", stored_path(F.col("section_path")).alias("section_path"), "text", "tokens", "chunk_index")
    return documents, embed_column(rows, provider)


def all_chunks(chunks: DataFrame) -> DataFrame:
    """Every chunk in document order, without a score."""
    return chunks.select("url", "chunk_index", "id", "text", "section_path", F.lit(None).cast("double").alias("score"))


def answer(queries: DataFrame, chunks: DataFrame, provider: EmbeddingProvider, k: int = MOST_RESULTS, threshold: float | None = similarity.THRESHOLD) -> DataFrame:
    """(query_id, url, place, id, text, score, section_path, source_ids) for queries (query_id, url, query).

    Blank queries are left out; equal queries keep their own ids. ``k`` is from 1 to 50.
    """
    checked_limit(k)
    asked = queries.filter(F.col("query").rlike(r"\S"))
    vectors = embed_column(asked.select("query_id", "url", F.col("query").alias("text")), provider)
    vectors = vectors.filter("embedding is not null").select("query_id", "url", F.col("embedding").alias("query_embedding"))
    usable = chunks.filter("embedding is not null").select("url", "id", "text", "section_path", "embedding")
    found = similarity.search(vectors, usable, k, threshold)
    return consolidate_results(found.select("query_id", "url", "rank", "id", "text", "score", "section_path"), most=None)  # k at most


def keyword_answer(queries: DataFrame, chunks: DataFrame, k: int = MOST_RESULTS) -> DataFrame:
    """The fallback without vectors: chunks with any word of the query, in document order, score 0.5."""
    checked_limit(k)
    joined = queries.filter(F.col("query").rlike(r"\S")).join(chunks.select("url", "chunk_index", "id", "text", "section_path"), "url")
    found = joined.filter(similarity.keyword_match(F.col("text"), F.col("query")))
    scored = found.withColumn("score", F.lit(0.5)).withColumn("dist", F.col("chunk_index"))
    return similarity.top_k(scored, k, threshold=None).drop("dist")


def references(answers: DataFrame, documents: DataFrame) -> DataFrame:
    """(query_id, url, last_crawled, relevant_chunks): a document's matches as one nested row."""
    chunk = F.struct("place", "id", "text", "score", "section_path")
    per = answers.groupBy("query_id", "url").agg(F.array_sort(F.collect_list(chunk)).alias("c"))  # at most k
    nested = F.transform("c", lambda c: F.struct(c["id"].alias("id"), c["text"].alias("text"), c["score"].alias("score"), F.split(c["section_path"], r"\|").alias("section_path")))
    return per.join(documents.select("url", "last_crawled"), "url", "left").select("query_id", "url", F.coalesce("last_crawled", F.current_timestamp()).alias("last_crawled"), nested.alias("relevant_chunks"))
