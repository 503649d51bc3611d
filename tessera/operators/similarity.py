"""Scoped vector search: many queries at once, ranked by L2 distance, scored by cosine.

The order of the three steps is part of the semantics: rank and limit, then threshold, then
consolidation. So a chunk beyond the limit is never seen, however good its score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors

THRESHOLD, MOST_RESULTS = 0.6, 8


def scored(queries: DataFrame, chunks: DataFrame, scope: str = "url") -> DataFrame:
    """Each query with all chunks of its scope: columns of both, ``score`` and ``dist``.

    queries: (query_id, scope, query_embedding); chunks: (id, scope, embedding, ...). The join is on
    the scope, so both sides are dealt by it (AQE splits scopes that are too large, and broadcasts the
    queries if they are small); norms are taken once a row, before the join.
    """
    q = queries.withColumn("_qn", vectors.norm(F.col("query_embedding")))
    c = chunks.withColumn("_cn", vectors.norm(F.col("embedding")))
    joined = q.join(c, scope)
    return joined.select(
        *[x for x in joined.columns if x not in ("_qn", "_cn")],
        vectors.cosine(F.col("query_embedding"), F.col("embedding"), F.col("_qn"), F.col("_cn")).alias("score"),
        vectors.l2(F.col("query_embedding"), F.col("embedding")).alias("dist"),
    )


def top_k(scores: DataFrame, k: int = MOST_RESULTS, scope: str = "url", threshold: float | None = THRESHOLD) -> DataFrame:
    """The k nearest of each query and scope with their ``rank``, then those that reach the threshold.

    The rank filter is in the form that Spark turns into a per-group limit before the shuffle.
    """
    nearest = Window.partitionBy("query_id", scope).orderBy("dist", "id")
    out = scores.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)
    return out if threshold is None else out.filter(F.col("score") >= F.lit(threshold))


def search(queries: DataFrame, chunks: DataFrame, k: int = MOST_RESULTS, threshold: float | None = THRESHOLD, scope: str = "url") -> DataFrame:
    """Exact search: the work is the number of queries of a scope times its chunks."""
    return top_k(scored(queries, chunks, scope), k, scope, threshold)


def keyword_match(text, query, trimmed: bool = True):
    """Whether any white-space separated term of the query is in the text, case ignored.

    Not ``trimmed``, a blank at an end of the query makes an empty term, which every text has.
    """
    terms = F.split(F.lower(F.trim(query) if trimmed else query), r"\s+")
    return F.exists(terms, lambda t: F.contains(F.lower(text), t))


def clean_queries(queries):
    """The queries of an array that aren't null or blank; empty means that all chunks are asked for."""
    return F.filter(F.coalesce(queries, F.array().cast("array<string>")), lambda q: q.rlike(r"\S"))
