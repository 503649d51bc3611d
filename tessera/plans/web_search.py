"""Search results with the matching passages of the pages that come first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..sources.embeddings import EmbeddingProvider
from . import read_page

PAGES_READ = 3


def first_pages(items: DataFrame, n: int = PAGES_READ) -> DataFrame:
    """The first n items of each query, with their canonical url (null if there is none; the item stays)."""
    place = Window.partitionBy("query_id").orderBy("ordinal")
    return items.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= n).withColumn("url", urls.normalize_url(F.col("link")))


def attach(items: DataFrame, matches: DataFrame) -> DataFrame:
    """Every item, with the matches (query_id, url, relevant_chunks) of its page where there are any."""
    keyed = items.withColumn("url", urls.normalize_url(F.col("link")))
    return keyed.join(matches, ["query_id", "url"], "left").drop("url")


def web_search(items: DataFrame, queries: DataFrame, pages: DataFrame, provider: EmbeddingProvider, threshold: float | None = 0.6, minimal: bool = False) -> DataFrame:
    """items (query_id, ordinal, link, ...), queries (query_id, query), pages (url, html): items with ``relevant_chunks``."""
    wanted = first_pages(items).filter("url is not null").select("query_id", "url").distinct()
    own = pages.withColumn("url", urls.normalize_url(F.col("url"))).join(wanted.select("url").distinct(), "url", "left_semi").dropDuplicates(["url"])
    _, chunks = read_page.ingest(own, provider, canonical=True)
    found = read_page.answer(wanted.join(queries, "query_id"), chunks, provider, read_page.SEARCH_RESULTS, threshold)
    matches = read_page.references(found, own.select("url", F.lit(None).cast("timestamp").alias("last_crawled")).distinct()).select("query_id", "url", "relevant_chunks")
    out = attach(items, matches)
    return out.drop("raw") if minimal else out
