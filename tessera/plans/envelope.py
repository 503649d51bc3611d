"""Response rows and their JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = "struct<id:string,text:string,score:double,sectionPath:array<string>>"


def page_responses(requests: DataFrame, answers: DataFrame, documents: DataFrame) -> DataFrame:
    """One row a requested page: (request_id, url, title, last_crawled, queries, note).

    requests: (request_id, url_in, url, query_id, query), a row for each query, in the order of query_id;
    the response has the url as it was given. A query without a result is there with an empty list; a
    null score (no query was asked) is left out of the JSON.
    """
    chunk = F.struct("place", "id", "text", "score", F.split("section_path", r"\|").alias("path"))
    lists = answers.groupBy("query_id", "url").agg(F.array_sort(F.collect_list(chunk)).alias("found"))  # at most k
    rows = requests.join(lists, ["query_id", "url"], "left")
    results = F.transform(F.coalesce("found", F.array()), lambda c: F.struct(c["id"].alias("id"), c["text"].alias("text"), c["score"].alias("score"), c["path"].alias("sectionPath")))
    rows = rows.withColumn("results", F.when(F.col("found").isNull(), F.array().cast(f"array<{RESULT}>")).otherwise(results.cast(f"array<{RESULT}>")))
    per = rows.groupBy("request_id", "url_in", "url").agg(F.array_sort(F.collect_list(F.struct("query_id", "query", "results"))).alias("q"))
    queries = F.transform("q", lambda q: F.struct(q["query"].alias("query"), q["results"].alias("results")))
    out = per.join(documents.select("url", "title", "last_crawled", "note"), "url", "left")
    return out.select("request_id", F.col("url_in").alias("url"), "title", F.coalesce("last_crawled", F.current_timestamp()).alias("last_crawled"), queries.alias("queries"), "note")


def to_json(row: DataFrame, name: str = "json", pretty: bool = True) -> DataFrame:
    """Every row as JSON text, keys in camel case, null fields left out."""
    camel = {c: "".join(p if i == 0 else p.title() for i, p in enumerate(c.split("_"))) for c in row.columns}
    return row.select(F.to_json(F.struct(*[F.col(c).alias(n) for c, n in camel.items()]), {"pretty": str(pretty).lower()}).alias(name))


def with_embedding_notes(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents whose chunks have no vectors are kept, with a note that says so."""
    failed = chunks.groupBy("url").agg(F.count("error").alias("failed"), F.max("error").alias("why")).filter("failed > 0")
    note = F.when(F.col("failed").isNotNull(), F.concat(F.lit("Content could not be embedded: "), F.col("why"))).otherwise(F.col("note"))
    return documents.join(failed, "url", "left").select(*[note.alias("note") if c == "note" else c for c in documents.columns])
