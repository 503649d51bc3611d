"""Statistics of the store and of its contents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .retention import CHUNK_BYTES, DOCUMENT_BYTES

#: Fixed value: estimated bytes of a cell.
CELL_BYTES = 50
#: Parts of a range that a pass for the median counts, and components that one task may sort.
EDGES, FEW = 4096, 100_000


def per_document(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every document with its number of chunks and tokens, 0 where it has none."""
    sums = chunks.groupBy("url").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"))
    return documents.join(sums, "url", "left").select(*documents.columns, F.coalesce("n", F.lit(0)).alias("chunk_count"), F.coalesce("t", F.lit(0)).alias("total_tokens"))


def store_stats(documents: DataFrame, chunks: DataFrame, meta: DataFrame) -> DataFrame:
    """One row: counts, oldest and newest crawl, size estimate, model and dimension."""
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    parts = [
        documents.agg(F.count("*").alias("documents"), F.min("last_crawled").alias("oldest"), F.max("last_crawled").alias("newest")).select("documents", none("long", "chunks"), "oldest", "newest", none("string", "embedding_model"), none("string", "embedding_dim")),
        chunks.agg(F.count("*").alias("chunks")).select(none("long", "documents"), "chunks", none("timestamp", "oldest"), none("timestamp", "newest"), none("string", "embedding_model"), none("string", "embedding_dim")),
        meta.agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in ("embedding_model", "embedding_dim")]).select(none("long", "documents"), none("long", "chunks"), none("timestamp", "oldest"), none("timestamp", "newest"), "embedding_model", "embedding_dim"),
    ]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    out = both.agg(*[F.max(c).alias(c) for c in both.columns])
    return out.withColumn("estimated_bytes", F.col("documents") * DOCUMENT_BYTES + F.col("chunks") * CHUNK_BYTES)


def table_bytes(rows: int, columns: int) -> int:
    return rows * columns * CELL_BYTES


def weighted_score(score, text):
    """Aggregate: mean score, weighted by text length."""
    n = F.length(text).cast("double")
    return F.sum(score * n) / F.nullif(F.sum(n), F.lit(0.0))


def by_section(chunks: DataFrame, *aggregates) -> DataFrame:
    """Aggregates by section; '' and null are the root."""
    return chunks.groupBy(F.coalesce(F.nullif(F.col("section_path"), F.lit("")), F.lit("root")).alias("section")).agg(*aggregates)


def chunk_report(chunks: DataFrame) -> DataFrame:
    """One row: chunks, total and mean tokens and overlap."""
    mean = lambda c, n: F.coalesce(F.avg(c), F.lit(0.0)).alias(n)
    return chunks.agg(F.count("*").alias("chunks"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"), mean("tokens", "mean_tokens"), F.coalesce(F.sum("overlap_tokens"), F.lit(0)).alias("total_overlap"), mean("overlap_tokens", "mean_overlap"))


def component_report(embeddings: DataFrame) -> DataFrame:
    """One row: least, greatest, mean and upper median of all components (the element at half of the count).

    The median is enclosed by counts in ``EDGES`` equal parts of a range, again and again of the part that holds it,
    until so few components are left that one task can sort them, or all are equal: an outlier costs another pass,
    of which a double's bits allow five. The passes run while the plan is made; each brings counts only.
    """
    each = embeddings.select(F.explode(F.col("embedding").cast("array<double>")).alias("x"))
    sums = each.agg(F.count("*").alias("n"), F.min("x").alias("least"), F.max("x").alias("greatest"), F.avg("x").alias("mean"))
    s = sums.first()
    if not s["n"]:
        return sums.withColumn("median", F.lit(None).cast("double"))
    before, inside, low, high, n = 0, each, s["least"], s["greatest"], s["n"]
    while n > FEW and low < high:
        width = (high - low) / EDGES
        place = F.least(F.greatest(F.floor((F.col("x") - low) / width), F.lit(0)), F.lit(EDGES - 1)) if width else F.lit(0)
        counts = inside.groupBy(place.alias("b")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        for r in counts.orderBy("b").collect():  # at most ``EDGES`` rows
            if before + r["n"] > s["n"] // 2:
                break
            before += r["n"]
        if r["n"] == n:
            break
        low, high, n = r["low"], r["high"], r["n"]
        inside = each.filter(F.col("x").between(low, high))
    upto = Window.orderBy("x")
    found = inside.groupBy("x").count().withColumn("upto", F.sum("count").over(upto)).filter(F.col("upto") > s["n"] // 2 - before).agg(F.min("x").alias("median"))
    return sums.withColumn("median", found.scalar())


def search_report(results: DataFrame, requests: DataFrame) -> DataFrame:
    """One row: queries, results, queries with a hit, success rate, mean score (0 when there's none)."""
    per = requests.select("query_id").join(results.groupBy("query_id").agg(F.count("*").alias("n"), F.sum("score").alias("s")), "query_id", "left")
    out = per.agg(F.count("*").alias("queries"), F.coalesce(F.sum("n"), F.lit(0)).alias("results"), F.count_if(F.col("n") > 0).alias("with_hit"), F.sum("s").alias("s"))
    return out.select("queries", "results", "with_hit", F.coalesce(F.col("with_hit") / F.nullif(F.col("queries"), F.lit(0)), F.lit(0.0)).alias("success_rate"), F.coalesce(F.col("s") / F.nullif(F.col("results"), F.lit(0)), F.lit(0.0)).alias("mean_score"))
