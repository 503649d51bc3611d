"""Every operator as a query over the driver's tables, with its SQL where SQL can say it.

Roles of the tables: embeddings are stored chunks with ``label`` as scope; documents are extracted
texts; pages are fetched pages; events are the crawl log; conversations the query log; benchmark the
query texts; labels rows to join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing, misc, urls, vectors
from ..functions import text as tx
from ..operators import similarity
from ..operators.chunking import chunk_documents, compat_path, stored_path
from ..operators.consolidation import consolidate_results
from ..operators.extraction import extract_pages, markdown_structure, pages_to_markdown
from ..operators.spread import spread
from ..session import table
from ..sources import providers, store
from ..sources.embeddings import HashProvider, embed_column
from . import envelope, read_page, retention, stats
from . import web_search as ws

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: The class of white space in RE2, as the native functions have it.
S = tx.SPACE


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def literal_rows(spark, values: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(values, schema)


# --- vector search ---------------------------------------------------------------------------------

_SCALED = "list_transform(embedding, lambda x: x::DOUBLE * (1 + vec_id % 7))"
_COS = "list_cosine_similarity({a}, {b})"
_L2 = "list_distance({a}, {b})"


def chunk_vectors(spark, d, scaled: bool = False) -> DataFrame:
    e = table(spark, d, "embeddings")
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * (1 + F.col("vec_id") % 7)) if scaled else F.col("embedding").cast("array<double>")
    return e.select(F.col("vec_id").alias("id"), F.col("label").alias("url"), v.alias("embedding"))


def one_query(chunks: DataFrame, unit: DataFrame) -> DataFrame:
    """Vector 0 as a query to every scope."""
    v = unit.filter("id = 0").select("embedding").scalar()
    scopes = chunks.select("url").distinct()
    return scopes.select("url", F.lit(0).cast("long").alias("query_id"), v.alias("query_embedding"))


def shown(found: DataFrame) -> DataFrame:
    return found.select("query_id", F.col("url").alias("label"), F.col("id").alias("vec_id"), F.col("rank").cast("int").alias("rank"), F.round("score", 6).alias("score"), F.round("dist", 6).alias("dist"))


def _search_sql(vector: str, k: int, threshold: float | None, queries: str) -> str:
    return f"""
WITH c AS (SELECT vec_id, label, {vector} AS v FROM embeddings),
q AS ({queries}),
s AS (SELECT q.query_id, c.label, c.vec_id, {_COS.format(a="c.v", b="q.v")} AS score, {_L2.format(a="c.v", b="q.v")} AS dist FROM c JOIN q ON c.label = q.label),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY dist, vec_id) AS rank FROM s)
SELECT query_id, label, vec_id, rank::INT AS rank, round(score, 6) AS score, round(dist, 6) AS dist FROM r
WHERE rank <= {k}""" + (f" AND score >= {threshold}" if threshold is not None else "")


_PLAIN = "embedding::DOUBLE[]"
_ZERO = "SELECT 0::BIGINT AS query_id, l.label, e.embedding::DOUBLE[] AS v FROM (SELECT DISTINCT label FROM embeddings) l, (SELECT embedding FROM embeddings WHERE vec_id = 0) e"


@query(_search_sql(_PLAIN, 8, None, _ZERO))
def sim_topk_cosine(spark, d):
    c = chunk_vectors(spark, d)
    return shown(similarity.search(one_query(c, c), c, 8, None))


@query(_search_sql(_SCALED, 8, None, _ZERO))
def sim_topk_l2_scaled(spark, d):
    c = chunk_vectors(spark, d, True)
    return shown(similarity.search(one_query(c, chunk_vectors(spark, d)), c, 8, None))


@query(_search_sql(_SCALED, 8, 0.1, _ZERO))
def sim_threshold_after_limit(spark, d):
    c = chunk_vectors(spark, d, True)
    return shown(similarity.search(one_query(c, chunk_vectors(spark, d)), c, 8, 0.1))


@query(_search_sql(_PLAIN, 5, 0.05, "SELECT vec_id AS query_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0"))
def sim_multi_query(spark, d):
    """Every vector whose id is divisible by 50 asks its own scope."""
    c = chunk_vectors(spark, d)
    q = c.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "url", F.col("embedding").alias("query_embedding"))
    return shown(similarity.search(q, c, 5, 0.05))


@query(f"""
WITH c AS (SELECT vec_id, label, list_transform(embedding, lambda x: CASE WHEN vec_id % 5 = 0 THEN 0 ELSE x::DOUBLE END) AS v FROM embeddings),
q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0)
SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN NULL ELSE round({_COS.format(a="c.v", b="q.v")}, 6) END AS score,
       coalesce(vec_id % 5 <> 0 AND {_COS.format(a="c.v", b="q.v")} >= 0.05, false) AS kept FROM c, q""")
def sim_zero_vector_guard(spark, d):
    """A zero vector has no score and passes no threshold."""
    c = chunk_vectors(spark, d)
    zeroed = c.withColumn("embedding", F.transform("embedding", lambda x: F.when(F.col("id") % 5 == 0, 0.0).otherwise(x)))
    s = similarity.scored(one_query(c, c), zeroed)
    return s.select(F.col("id").alias("vec_id"), F.round("score", 6).alias("score"), F.coalesce(F.col("score") >= 0.05, F.lit(False)).alias("kept"))


@query("SELECT vec_id, (row_number() OVER (ORDER BY vec_id) - 1)::INT AS chunk_index, len(embedding)::INT AS dim FROM embeddings WHERE label = 3")
def scope_filter_chunks(spark, d):
    e = table(spark, d, "embeddings").filter("label = 3")
    return e.select("vec_id", (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).alias("chunk_index"), F.size(vectors.checked(F.col("embedding"), 64)).alias("dim"))


@query("SELECT label, vec_id, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INT AS chunk_index, NULL::DOUBLE AS score FROM embeddings")
def all_chunks_in_order(spark, d):
    e = table(spark, d, "embeddings")
    chunks = e.select(F.col("label").alias("url"), F.col("vec_id").alias("id"), (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).alias("chunk_index"), F.lit("").alias("text"), F.lit(None).cast("string").alias("section_path"))
    return read_page.all_chunks(chunks).select(F.col("url").alias("label"), F.col("id").alias("vec_id"), "chunk_index", "score")


@query("""SELECT vec_id, len(b)::INT AS batches, list_transform(b, lambda x: len(x)::INT)[len(b)] AS last_size FROM (
SELECT vec_id, list_transform(range(0, len(embedding), 10), lambda i: embedding[i + 1 : i + 10]) AS b FROM embeddings)""")
def vector_batches(spark, d):
    b = vectors.batches(F.col("embedding"), 10)
    return table(spark, d, "embeddings").select("vec_id", F.size(b).alias("batches"), F.size(F.element_at(b, -1)).alias("last_size"))


@query("""WITH x AS (SELECT unnest(embedding)::DOUBLE AS v FROM embeddings), r AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM x)
SELECT count(*) AS n, round(min(v), 9) AS least, round(max(v), 9) AS greatest, round(avg(v), 9) AS mean, round(max(CASE WHEN i = n // 2 THEN v END), 9) AS median FROM r""")
def embedding_report(spark, d):
    r = stats.component_report(table(spark, d, "embeddings"))
    return r.select("n", *[F.round(c, 9).alias(c) for c in ("least", "greatest", "mean", "median")])


# --- queries ---------------------------------------------------------------------------------------

ASKED = "  thenti EREA nowhere "


@query(f"""WITH t AS (SELECT unnest(regexp_split_to_array(lower(trim('{ASKED}')), '[ \\t\\n\\r\\f\\v]+')) AS term)
SELECT doc_id, 0.5::DOUBLE AS score FROM documents WHERE EXISTS (SELECT 1 FROM t WHERE contains(lower(text), term))""")
def keyword_fallback(spark, d):
    docs = table(spark, d, "documents")
    return docs.filter(similarity.keyword_match(F.col("text"), F.lit(ASKED))).select("doc_id", F.lit(0.5).alias("score"))


@query("SELECT doc_id, 0.5::DOUBLE AS score FROM documents")
def keyword_fallback_compat(spark, d):
    """A query that isn't trimmed has an empty term, which every text holds."""
    docs = table(spark, d, "documents")
    return docs.filter(similarity.keyword_match(F.col("text"), F.lit(ASKED), trimmed=False)).select("doc_id", F.lit(0.5).alias("score"))


@query(r"""WITH q AS (SELECT conv_id, list(CASE WHEN role = 'user' THEN text WHEN role = 'system' THEN ' ' ELSE '' END) AS qs FROM conversations GROUP BY conv_id)
SELECT conv_id, len(qs)::INT AS given, len(list_filter(qs, lambda x: regexp_matches(x, '\S')))::INT AS asked,
CASE WHEN len(list_filter(qs, lambda x: regexp_matches(x, '\S'))) = 0 THEN 'all' ELSE 'search' END AS mode FROM q""")
def query_blank_filter(spark, d):
    text = F.when(F.col("role") == "user", F.col("text")).when(F.col("role") == "system", " ").otherwise("")
    q = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(text).alias("qs"))
    asked = F.size(similarity.clean_queries(F.col("qs")))
    return q.select("conv_id", F.size("qs").alias("given"), asked.alias("asked"), F.when(asked == 0, "all").otherwise("search").alias("mode"))


@query("SELECT doc_id, least(greatest(coalesce(CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id % 60 - 3 END, 5), 1), 10)::INT AS google, least(greatest(coalesce(CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id % 60 - 3 END, 5), 1), 20)::INT AS brave, least(greatest(coalesce(CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id % 60 - 3 END, 5), 1), 50)::INT AS duckduckgo FROM documents")
def clamp_results(spark, d):
    asked = F.when(F.col("doc_id") % 7 != 0, (F.col("doc_id") % 60 - 3).cast("int"))
    return table(spark, d, "documents").select("doc_id", *[misc.clamp(asked, misc.MOST_RESULTS[p]).alias(p) for p in ("google", "brave", "duckduckgo")])


_RANGE = "(['day', 'week', 'month', 'year', 'other'])[(event_id % 5 + 1)::INT]"


@query(f"""SELECT event_id, CASE {_RANGE} WHEN 'day' THEN 'd1' WHEN 'week' THEN 'w1' WHEN 'month' THEN 'm1' WHEN 'year' THEN 'y1' END AS google,
CASE {_RANGE} WHEN 'day' THEN 'pd' WHEN 'week' THEN 'pw' WHEN 'month' THEN 'pm' WHEN 'year' THEN 'py' END AS brave FROM events""")
def time_range_map(spark, d):
    value = F.element_at(F.array(*[F.lit(x) for x in ("day", "week", "month", "year", "other")]), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", misc.time_range("google", value).alias("google"), misc.time_range("brave", value).alias("brave"))


# --- URLs and hashes -------------------------------------------------------------------------------

#: URLs that the pages don't have: ports, upper case, repeated names, doubled slashes, other schemes.
ODD_URLS = [
    (-1, "HTTPS://Example.COM:443/a//b/?utm_source=x&b=2&a=1#frag"),
    (-2, "http://example.com:8080"),
    (-3, "http://EXAMPLE.com:80/x/?a=1&a=2"),
    (-4, "ftp://example.com/x"),
    (-5, "no url"),
    (-6, "https://u:p@h.org/?GCLID=1&z=&y"),
    (-7, None),
]


def page_urls(spark, d) -> DataFrame:
    return table(spark, d, "pages").select("page_id", "url").unionByName(literal_rows(spark, ODD_URLS, "page_id long, url string"))


_PAGE_URLS = "(SELECT page_id, url FROM pages UNION ALL VALUES " + ", ".join(f"({i}, {'NULL' if u is None else repr(u)})" for i, u in ODD_URLS) + ") AS p(page_id, url)"


@query(f"""
WITH a AS (SELECT page_id, url, lower(regexp_extract(url, '(?i)^(https?)://([^/?#]+)([^?#]*)(?:\\?([^#]*))?', 1)) AS scheme,
  regexp_extract(url, '(?i)^(https?)://([^/?#]+)([^?#]*)(?:\\?([^#]*))?', 2) AS auth,
  regexp_extract(url, '(?i)^(https?)://([^/?#]+)([^?#]*)(?:\\?([^#]*))?', 3) AS path,
  regexp_extract(url, '(?i)^(https?)://([^/?#]+)([^?#]*)(?:\\?([^#]*))?', 4) AS query FROM {_PAGE_URLS}),
b AS (SELECT *, regexp_extract(auth, '^(.*@)?', 0) AS usr, lower(regexp_replace(auth, '^.*@', '')) AS site, regexp_replace(path, '/{{2,}}', '/', 'g') AS p2,
  list_filter(list_transform(list_filter(string_split(query, '&'), lambda x: x <> ''), lambda x: {{'k': split_part(x, '=', 1), 'v': substr(x, len(split_part(x, '=', 1)) + 2)}}),
   lambda t: NOT list_contains(['utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'gclid', 'fbclid', 'igshid', 'mc_cid', 'mc_eid'], lower(t.k))) AS kv FROM a),
c AS (SELECT page_id, scheme, usr, CASE WHEN scheme = 'http' THEN regexp_replace(site, ':(80)?$', '') ELSE regexp_replace(site, ':(443)?$', '') END AS host,
  CASE WHEN len(p2) > 1 THEN regexp_replace(p2, '/$', '') ELSE '/' END AS p3,
  array_to_string(list_transform(list_sort(list_transform(kv, lambda t: t.k)), lambda n: n || '=' || list_filter(kv, lambda t: t.k = n)[1].v), '&') AS q FROM b)
SELECT page_id, CASE WHEN scheme IN ('http', 'https') THEN scheme || '://' || usr || host || p3 || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS normal FROM c""")
def url_normalize(spark, d):
    return page_urls(spark, d).select("page_id", urls.normalize_url(F.col("url")).alias("normal"))


@query(f"SELECT page_id, coalesce(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '') AS host FROM {_PAGE_URLS}")
def url_host_display(spark, d):
    return page_urls(spark, d).select("page_id", urls.display_link(F.col("url")).alias("host"))


@query(f"SELECT page_id, coalesce(regexp_matches(url, '(?i)^https?://[^/?#]'), false) AS valid FROM {_PAGE_URLS}")
def url_valid(spark, d):
    return page_urls(spark, d).select("page_id", urls.is_http_url(F.col("url")).alias("valid"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def sha_content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", hashing.content_hash(F.col("text")).alias("content_hash"))


@query("SELECT doc_id, sha256('doc:' || doc_id || '|' || lang || '/' || source || '|' || text) AS id, lang || ' > ' || source AS stored, [lang || ' > ' || source] AS edge FROM documents")
def chunk_id_stable(spark, d):
    docs = table(spark, d, "documents")
    path = F.array("lang", "source")
    return docs.select("doc_id", hashing.chunk_id(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")), path, F.col("text")).alias("id"), stored_path(path).alias("stored"), compat_path(stored_path(path)).alias("edge"))


@query("SELECT doc_id, trim(regexp_replace(lower(source || ' Model_' || lang || '!'), '[^a-z0-9]+', '-', 'g'), '-') AS directory FROM documents")
def model_directories(spark, d):
    return table(spark, d, "documents").select("doc_id", misc.model_directory_column(F.concat("source", F.lit(" Model_"), "lang", F.lit("!"))).alias("directory"))


# --- text ------------------------------------------------------------------------------------------

_JS_LENGTH = "(length({t}) + len(regexp_extract_all({t}, '[\\x{{10000}}-\\x{{10FFFF}}]')))"
_KINDS = list(tx.TOKEN_RATIOS)


@query(f"""SELECT doc_id, ceil({_JS_LENGTH.format(t="text")} / 4.0::DOUBLE)::INT AS tokens,
ceil({_JS_LENGTH.format(t="text")} / (CASE doc_id % 7 {' '.join(f'WHEN {i} THEN {r}::DOUBLE' for i, r in enumerate(tx.TOKEN_RATIOS.values()))} END))::INT AS block_tokens FROM documents""")
def token_estimate(spark, d):
    docs = table(spark, d, "documents")
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (F.col("doc_id") % 7 + 1).cast("int"))
    return docs.select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"), tx.block_token_estimate(F.col("text"), kind).alias("block_tokens"))


@query(f"SELECT lang, count(*) AS docs, sum(ceil({_JS_LENGTH.format(t='text')} / 4.0::DOUBLE))::BIGINT AS tokens FROM documents GROUP BY lang")
def token_sum_by_lang(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("docs"), F.sum(tx.token_estimate(F.col("text"))).alias("tokens"))


def _chain(column: str, patterns: list[str], by: str = "' '") -> str:
    for p in patterns:
        column = "regexp_replace(" + column + ", '" + p.replace("'", "''") + f"', {by}, 'g')"
    return column


_CLEAN = f"trim({_chain('html', [*tx.CUT_PATTERNS, '<[^>]+>', S + '+'])})"


@query(f"SELECT page_id, {_CLEAN} AS text, length({_CLEAN})::INT AS n FROM pages")
def clean_html_raw(spark, d):
    text = tx.clean_html(F.col("html"))
    return spread(table(spark, d, "pages").select("page_id", "html")).select("page_id", text.alias("text")).select("page_id", "text", F.length("text").alias("n"))


@query("SELECT page_id, CASE WHEN regexp_matches(html, '(?i)<title[^>]*>[^\\n\\r]*?</title>') THEN trim(regexp_extract(html, '(?i)<title[^>]*>([^\\n\\r]*?)</title>', 1)) END AS title FROM pages")
def html_title(spark, d):
    return table(spark, d, "pages").select("page_id", tx.html_title(F.col("html")).alias("title"))


_CSS_INPUT = "regexp_extract(html, '(?is)<style[^>]*>(.*?)</style>', 1) || ' ' || coalesce(regexp_extract(html, '(?i)<title[^>]*>([^\\n\\r]*?)</title>', 1), '') || ' #main {{ x: y }} .a-b {{}} -ms-filter: none; kept'".replace("{{", "{").replace("}}", "}")


@query(f"SELECT page_id, trim({_chain('(' + _CSS_INPUT + ')', [*tx.CSS_PATTERNS, S + '+'])}) AS text FROM pages")
def css_leak_clean(spark, d):
    leak = F.concat(F.regexp_extract("html", r"(?is)<style[^>]*>(.*?)</style>", 1), F.lit(" "), F.coalesce(F.regexp_extract("html", r"(?i)<title[^>]*>([^\n\r]*?)</title>", 1), F.lit("")), F.lit(" #main { x: y } .a-b {} -ms-filter: none; kept"))
    return table(spark, d, "pages").select("page_id", tx.clean_rendered_css(leak).alias("text"))


@query("SELECT doc_id, sha256(regexp_replace(replace(text, ' ', ''), '([α-ωa-z0-9])([Α-ΩA-Z])', '\\1 \\2', 'g')) AS split FROM documents")
def camel_split(spark, d):
    return table(spark, d, "documents").select("doc_id", hashing.content_hash(tx.split_camel_case(F.replace("text", F.lit(" "), F.lit("")))).alias("split"))


def _excerpt_sql(n: int) -> str:
    t = f"regexp_replace(regexp_replace(substr(text, 1, {n}), '^{S}+', ''), '{S}+$', '')"
    return f"SELECT doc_id, CASE WHEN {t} <> '' THEN {t} || CASE WHEN length(text) > {n} THEN '...' ELSE '' END END AS excerpt FROM documents"


@query(_excerpt_sql(200))
def excerpt_200(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.excerpt(F.col("text"), 200).alias("excerpt"))


@query(_excerpt_sql(300))
def excerpt_300(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.excerpt(F.col("text"), 300).alias("excerpt"))


@query(f"""SELECT doc_id, len(regexp_extract_all(text, '{tx.NOT_SPACE}+'))::INT AS words, (len(regexp_extract_all(text, '{S}+')) + 1)::INT AS split_words,
{_JS_LENGTH.format(t="text")}::INT AS characters, len(regexp_extract_all(text, '(?m)^[*-] '))::INT AS items FROM documents""")
def word_char_counts(spark, d):
    t = F.col("text")
    # one count of blanks tells both: white space at an end makes an empty piece
    bare, blank = tx.js_trim(t), lambda c: F.when(c, 1).otherwise(0)
    words = F.when(bare == "", 0).otherwise(F.col("split_words") - blank(~t.startswith(F.substring(bare, 1, 1))) - blank(~t.endswith(F.substring(bare, -1, 1))))
    return spread(table(spark, d, "documents").select("doc_id", "text")).withColumn("split_words", tx.split_word_count(t)).select("doc_id", words.cast("int").alias("words"), "split_words", tx.js_length(t).cast("int").alias("characters"), tx.list_item_count(t).alias("items"))


def _trim_sql(t: str) -> str:
    return f"regexp_replace(regexp_replace({t}, '^{S}+', ''), '{S}+$', '')"


def _structure_sql() -> str:
    marked = "CASE WHEN doc_id % 3 = 0 THEN '# ' || replace(text, chr(10), chr(10) || '- ') WHEN doc_id % 3 = 1 THEN '```x' || chr(10) || text || chr(10) || '```' || chr(10) || substr(text, 1, 80) ELSE text END"
    ctes, last = [f"s0 AS (SELECT doc_id, {_trim_sql(marked)} AS whole, {_trim_sql(marked)} AS rest FROM documents)"], "s0"
    for i, p in enumerate(tx.STRUCTURE_PATTERNS, 1):
        ctes.append(f"s{i} AS (SELECT doc_id, whole, " + _trim_sql("regexp_replace(rest, '" + p + "', '', 'g')") + f" AS rest FROM {last})")
        last = f"s{i}"
    return "WITH " + ",\n".join(ctes) + f" SELECT doc_id, {_JS_LENGTH.format(t='rest')} < {_JS_LENGTH.format(t='whole')} * 0.3::DOUBLE AS structural FROM {last}"


@query(_structure_sql())
def structural_flag(spark, d):
    t = F.col("text")
    marked = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("# "), F.replace(t, F.lit("\n"), F.lit("\n- ")))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("```x\n"), t, F.lit("\n```\n"), F.substring(t, 1, 80))).otherwise(t)
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", tx.is_structural(marked).alias("structural"))


@query(f"""WITH m AS (SELECT doc_id, regexp_replace(replace(text, '. ', chr(10) || chr(10) || chr(10) || chr(10) || '# '), ', ', chr(10) || '- ', 'g') AS t FROM documents)
SELECT doc_id, sha256({_trim_sql("regexp_replace(regexp_replace(regexp_replace(t, '\\n{4,}', chr(10) || chr(10) || chr(10), 'g'), '([^\\n])\\n(#{1,6} )', '\\1' || chr(10) || chr(10) || '\\2', 'g'), '([^\\n])\\n([*-] )', '\\1' || chr(10) || chr(10) || '\\2', 'g')")}) AS tidy FROM m""")
def markdown_tidy(spark, d):
    t = F.regexp_replace(F.replace("text", F.lit(". "), F.lit("\n\n\n\n# ")), ", ", "\n- ")
    return table(spark, d, "documents").select("doc_id", hashing.content_hash(tx.post_process_markdown(t)).alias("tidy"))


@query("""SELECT conv_id, turn, CASE WHEN contains(text, 'function ') OR contains(text, '=>') THEN 'javascript' WHEN contains(text, 'def ') OR contains(text, 'import ') THEN 'python'
WHEN contains(text, 'SELECT ') OR contains(text, 'FROM ') THEN 'sql' WHEN contains(text, '<?php') THEN 'php' ELSE '' END AS guessed,
CASE WHEN turn % 2 = 0 THEN role ELSE CASE WHEN contains(text, 'function ') OR contains(text, '=>') THEN 'javascript' WHEN contains(text, 'def ') OR contains(text, 'import ') THEN 'python'
WHEN contains(text, 'SELECT ') OR contains(text, 'FROM ') THEN 'sql' WHEN contains(text, '<?php') THEN 'php' ELSE '' END END AS named FROM conversations""")
def code_language(spark, d):
    named = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("x lang-"), F.col("role"))).otherwise("plain")
    return table(spark, d, "conversations").select("conv_id", "turn", tx.code_language(F.lit(""), F.col("text")).alias("guessed"), tx.code_language(named, F.col("text")).alias("named"))


@query(f"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '{S}+'), lambda x: length(x) > 2) AS a FROM documents),
b AS (SELECT list_filter(regexp_split_to_array(lower(string_agg(text, ' ' ORDER BY item_id)), '{S}+'), lambda x: length(x) > 2) AS v FROM benchmark)
SELECT doc_id, len(a)::INT AS words, len(list_filter(a, lambda x: list_contains(v, x)))::INT AS common FROM w, b""")
def common_words(spark, d):
    """Words of each document, repeats included, that the benchmark has."""
    words = lambda t: F.filter(F.split(F.lower(t), f"{S}+"), lambda x: F.length(x) > 2)
    docs = table(spark, d, "documents").select("doc_id", words(F.col("text")).alias("a"))
    known = table(spark, d, "benchmark").select(F.explode(words(F.col("text"))).alias("w")).distinct()
    counts = docs.select("doc_id", F.explode("a").alias("w")).groupBy("doc_id", "w").agg(F.count("*").alias("n"))
    common = counts.join(known, "w", "left_semi").groupBy("doc_id").agg(F.sum("n").alias("c"))
    return docs.join(common, "doc_id", "left").select("doc_id", F.size("a").alias("words"), F.coalesce("c", F.lit(0)).cast("int").alias("common"))


# --- store -----------------------------------------------------------------------------------------


def crawl_log(spark, d) -> DataFrame:
    """Documents: the last event of each user; title and etag can be null."""
    e = table(spark, d, "events")
    rows = e.select(F.concat(F.lit("http://u/"), F.col("user_id").cast("string")).alias("url"), F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("title"), F.when(F.col("event_id") % 4 != 0, F.col("event_id").cast("string")).alias("etag"), F.col("ts").alias("last_crawled"), "event_id")
    return store.latest(rows, "url", F.struct("last_crawled", "event_id").desc())


_CRAWL = "SELECT * EXCLUDE (n) FROM (SELECT 'http://u/' || user_id AS url, CASE WHEN event_id % 3 <> 0 THEN event_type END AS title, CASE WHEN event_id % 4 <> 0 THEN event_id::VARCHAR END AS etag, ts AS last_crawled, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1"


def stored_chunks(spark, d) -> DataFrame:
    """Chunks: the line items of each user's orders stand for a page's chunks; some have no document."""
    li = table(spark, d, "lineitem")
    return li.select(F.concat(F.lit("http://u/"), (F.col("l_suppkey") * 3).cast("string")).alias("url"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.col("l_quantity").cast("int").alias("tokens"))


_CHUNKS = "SELECT 'http://u/' || (l_suppkey * 3) AS url, l_orderkey || '-' || l_linenumber AS id, l_quantity::INT AS tokens FROM lineitem"
CUTOFF = "2024-01-28 12:00:00"


@query(f"SELECT url, title, etag, last_crawled, event_id FROM ({_CRAWL})")
def upsert_latest(spark, d):
    return crawl_log(spark, d)


@query(f"""WITH old AS ({_CRAWL}), new AS (SELECT url, NULL::VARCHAR AS title, CASE WHEN event_id % 2 = 0 THEN 'n' || event_id END AS etag, last_crawled, event_id FROM old WHERE etag IS NULL)
SELECT url, title, etag, event_id FROM old WHERE url NOT IN (SELECT url FROM new) UNION ALL SELECT url, title, etag, event_id FROM new""")
def upsert_null_overwrite(spark, d):
    """Rows without an etag come again and are replaced whole: nulls overwrite."""
    old = crawl_log(spark, d)
    new = old.filter("etag IS NULL").withColumn("title", F.lit(None).cast("string")).withColumn("etag", F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("n"), F.col("event_id").cast("string"))))
    return store.upsert(old, new, "url").select("url", "title", "etag", "event_id")


@query(f"""WITH old AS ({_CRAWL})
SELECT url, title, CASE WHEN event_id % 5 = 0 THEN etag ELSE coalesce(CASE WHEN event_id % 2 = 0 THEN 'n' || event_id END, etag) END AS etag,
CASE WHEN event_id % 5 = 0 THEN sha256('old') ELSE sha256('body' || event_id) END AS content_hash FROM old""")
def upsert_coalesce(spark, d):
    """After a fetch, missing validators stay as they were; 304 renews the crawl time only."""
    old = crawl_log(spark, d)
    docs = old.select("url", "title", "etag", F.lit(None).cast("string").alias("last_modified"), "last_crawled", F.sha2(F.lit("old").cast("binary"), 256).alias("content_hash"))
    fetched = old.select("url", F.when(F.col("event_id") % 5 == 0, 304).otherwise(200).alias("status"), F.concat(F.lit("body"), F.col("event_id").cast("string")).alias("body"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("n"), F.col("event_id").cast("string"))).alias("etag"), F.lit(None).cast("string").alias("last_modified"), F.lit("2024-02-01 00:00:00").cast("timestamp").alias("fetched_at"))
    return store.refreshed(docs, fetched).select("url", "title", "etag", "content_hash")


@query(f"WITH old AS ({_CRAWL}) SELECT url, CASE WHEN event_id % 2 = 0 THEN etag ELSE 'changed' END AS asked, coalesce(CASE WHEN event_id % 2 = 0 THEN etag ELSE 'changed' END = etag, false) AS unchanged FROM old UNION ALL SELECT 'http://new/' || page_id, 'e', false FROM pages")
def revalidate_unchanged(spark, d):
    old = crawl_log(spark, d)
    asked = old.select("url", F.when(F.col("event_id") % 2 == 0, F.col("etag")).otherwise("changed").alias("etag"))
    asked = asked.unionByName(table(spark, d, "pages").select(F.concat(F.lit("http://new/"), F.col("page_id").cast("string")).alias("url"), F.lit("e").alias("etag")))
    return store.revalidated(asked, old).select("url", F.col("etag").alias("asked"), "unchanged")


@query(f"""WITH c AS ({_CHUNKS}), doc AS ({_CRAWL})
SELECT 'chunk' AS kind, id AS key FROM c WHERE url NOT IN (SELECT url FROM doc WHERE title IS NULL)
UNION ALL SELECT 'document', url FROM doc WHERE title IS NOT NULL""")
def delete_cascade(spark, d):
    docs, chunks = crawl_log(spark, d), stored_chunks(spark, d)
    gone = docs.filter("title IS NULL").select("url")
    left = chunks.join(gone, "url", "left_anti").select(F.lit("chunk").alias("kind"), F.col("id").alias("key"))
    return left.unionByName(docs.join(gone, "url", "left_anti").select(F.lit("document").alias("kind"), F.col("url").alias("key")))


@query(f"""WITH c AS ({_CHUNKS}), doc AS ({_CRAWL}), old AS (SELECT url FROM doc WHERE last_crawled < TIMESTAMP '{CUTOFF}'),
n AS (SELECT (SELECT count(*) FROM old) AS documents, (SELECT count(*) FROM c WHERE url IN (SELECT url FROM old)) AS chunks)
SELECT documents, chunks, documents * 1000 + chunks * 500 AS bytes_saved FROM n""")
def retention_dry_run(spark, d):
    return retention.dry_run(crawl_log(spark, d), stored_chunks(spark, d), F.lit(CUTOFF).cast("timestamp_ntz"))


@query(f"""WITH c AS ({_CHUNKS}), doc AS ({_CRAWL}), old AS (SELECT url FROM doc WHERE last_crawled < TIMESTAMP '{CUTOFF}')
SELECT 'document' AS kind, url AS key FROM doc WHERE url NOT IN (SELECT url FROM old) UNION ALL SELECT 'chunk', id FROM c WHERE url NOT IN (SELECT url FROM old)""")
def retention_survivors(spark, d):
    docs, chunks = retention.survivors(crawl_log(spark, d), stored_chunks(spark, d), F.lit(CUTOFF).cast("timestamp_ntz"))
    return docs.select(F.lit("document").alias("kind"), F.col("url").alias("key")).unionByName(chunks.select(F.lit("chunk").alias("kind"), F.col("id").alias("key")))


@query(f"WITH c AS ({_CHUNKS}), doc AS ({_CRAWL}) SELECT doc.url, count(c.id) AS chunk_count, coalesce(sum(c.tokens), 0)::BIGINT AS total_tokens FROM doc LEFT JOIN c ON doc.url = c.url GROUP BY doc.url")
def doc_stats_per_key(spark, d):
    return stats.per_document(crawl_log(spark, d), stored_chunks(spark, d)).select("url", "chunk_count", "total_tokens")


@query(f"""WITH c AS ({_CHUNKS}), doc AS ({_CRAWL})
SELECT (SELECT count(*) FROM doc) AS documents, (SELECT count(*) FROM c) AS chunks, (SELECT strftime(min(last_crawled), '%Y-%m-%d %H:%M:%S') FROM doc) AS oldest, (SELECT strftime(max(last_crawled), '%Y-%m-%d %H:%M:%S') FROM doc) AS newest,
'm1' AS embedding_model, '64' AS embedding_dim, (SELECT count(*) FROM doc) * 1000 + (SELECT count(*) FROM c) * 500 AS estimated_bytes""")
def db_stats(spark, d):
    docs = crawl_log(spark, d).withColumn("last_crawled", F.col("last_crawled").cast("timestamp"))
    meta = literal_rows(spark, [("embedding_model", "m1"), ("embedding_dim", "64"), ("other", "x")], store.META)
    out = stats.store_stats(docs, stored_chunks(spark, d), meta)
    show = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select("documents", "chunks", show("oldest"), show("newest"), "embedding_model", "embedding_dim", "estimated_bytes")


_TABLES = ["benchmark", "conversations", "documents", "embeddings", "events", "labels", "pages"]


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n, (SELECT count(*) FROM (DESCRIBE {t})) AS n_columns, count(*) * (SELECT count(*) FROM (DESCRIBE {t})) * 50 AS bytes FROM {t}" for t in _TABLES))
def table_inventory(spark, d):
    """Rows, columns and estimated size of each table."""
    rows = []
    for t in _TABLES:
        df = table(spark, d, t)
        n = len(df.columns)
        rows.append(df.agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n", F.lit(n).cast("long").alias("n_columns"), (F.col("n") * n * stats.CELL_BYTES).alias("bytes")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


# --- results ---------------------------------------------------------------------------------------


def result_items(spark, d) -> DataFrame:
    """Items of each query, with an ordinal: a query for every five pages."""
    p = table(spark, d, "pages")
    rows = p.select(F.floor(F.col("page_id") / 5).alias("query_id"), F.col("url").alias("link"), "page_id")
    return rows.withColumn("ordinal", (F.row_number().over(Window.partitionBy("query_id").orderBy("page_id")) - 1).cast("int"))


_ITEMS = "SELECT page_id // 5 AS query_id, url AS link, page_id, (row_number() OVER (PARTITION BY page_id // 5 ORDER BY page_id) - 1)::INT AS ordinal FROM pages"


@query(f"WITH i AS ({_ITEMS}) SELECT query_id, page_id, (ordinal + 1)::INT AS place FROM i WHERE ordinal < 3")
def top3_per_query(spark, d):
    return ws.first_pages(result_items(spark, d)).select("query_id", "page_id", F.col("place").cast("int").alias("place"))


@query(f"""WITH i AS ({_ITEMS}), l AS (SELECT p.page_id, lb.doc_id, lb.quality FROM pages p JOIN labels lb ON lb.doc_id // 4 = p.page_id),
m AS (SELECT page_id, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids FROM l GROUP BY page_id)
SELECT i.query_id, i.page_id, coalesce(m.n, 0) AS n, m.ids FROM i LEFT JOIN m ON i.page_id = m.page_id""")
def attach_matches(spark, d):
    """Every item keeps its row; those with matches have them as a list."""
    items = result_items(spark, d)
    p, lb = table(spark, d, "pages"), table(spark, d, "labels")
    pairs = p.select("page_id", "url").join(lb.select("doc_id", F.floor(F.col("doc_id") / 4).alias("page_id")), "page_id")
    per = pairs.groupBy("page_id", "url").agg(F.array_sort(F.collect_list("doc_id")).alias("relevant_chunks"))
    found = per.select(F.floor(F.col("page_id") / 5).alias("query_id"), urls.normalize_url(F.col("url")).alias("url"), "relevant_chunks")
    out = ws.attach(items, found)
    return out.select("query_id", "page_id", F.coalesce(F.size("relevant_chunks"), F.lit(0)).cast("long").alias("n"), F.array_join(F.col("relevant_chunks").cast("array<string>"), ",").alias("ids"))


@query("SELECT source, lang, round(sum((doc_id % 100) / 100.0::DOUBLE * length(text)) / sum(length(text)), 9) AS score FROM documents GROUP BY source, lang")
def weighted_score(spark, d):
    docs = table(spark, d, "documents")
    return docs.groupBy("source", "lang").agg(F.round(stats.weighted_score((F.col("doc_id") % 100) / F.lit(100.0), F.col("text")), 9).alias("score"))


@query("SELECT coalesce(nullif(CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 4 = 1 THEN NULL ELSE source END, ''), 'root') AS section, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1")
def group_by_section(spark, d):
    docs = table(spark, d, "documents").withColumn("section_path", F.when(F.col("doc_id") % 4 == 0, "").when(F.col("doc_id") % 4 != 1, F.col("source")))
    return stats.by_section(docs, F.count("*").alias("n"), F.min("doc_id").alias("first"))


@query("SELECT doc_id, 0 AS part, 'web' AS result_type FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, 1, 'news' FROM documents WHERE lang <> 'en'")
def union_web_news(spark, d):
    docs = table(spark, d, "documents")
    part = lambda cond, name: docs.filter(cond).select("doc_id", F.lit(name).alias("result_type"))
    return providers.union_ordered([part("lang = 'en'", "web"), part("lang <> 'en'", "news")])


_MESSAGES = ["request timeout", "status 429 rate limit", "status 503", "database locked", "connection refused", "rate limit hit", "ECONNRESET", "other", "status unknown", "error 429"]


@query(f"""WITH m AS (SELECT event_id, ({_MESSAGES!r})[(event_id % {len(_MESSAGES)} + 1)::INT] AS message FROM events)
SELECT event_id, CASE WHEN contains(message, 'timeout') OR contains(message, 'ECONNRESET') THEN 'network' WHEN contains(message, 'status') AND regexp_matches(message, '[0-9]{{3}}') THEN 'embedding'
WHEN contains(message, 'database') OR contains(message, 'connection') THEN 'database' WHEN contains(message, 'rate') OR contains(message, '429') THEN 'rate_limit' ELSE 'embedding' END AS error_type,
CASE WHEN contains(message, 'timeout') OR contains(message, 'ECONNRESET') THEN true WHEN contains(message, 'status') AND regexp_matches(message, '[0-9]{{3}}') THEN regexp_extract(message, 'status ([0-9]+)', 1) = '429'
WHEN contains(message, 'database') OR contains(message, 'connection') THEN true WHEN contains(message, 'rate') OR contains(message, '429') THEN true ELSE false END AS retryable FROM m""")
def error_classify(spark, d):
    message = F.element_at(F.array(*[F.lit(m) for m in _MESSAGES]), (F.col("event_id") % len(_MESSAGES) + 1).cast("int"))
    return table(spark, d, "events").select("event_id", misc.error_class(message).alias("e")).select("event_id", "e.error_type", "e.retryable")


@query(f"""WITH s AS ({_search_sql(_PLAIN, 5, 0.05, "SELECT vec_id AS query_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0")}),
q AS (SELECT vec_id AS query_id FROM embeddings), n AS (SELECT q.query_id, count(s.vec_id) AS n, sum(s.score) AS t FROM q LEFT JOIN s ON q.query_id = s.query_id GROUP BY 1)
SELECT count(*) AS queries, sum(n)::BIGINT AS results, count(*) FILTER (n > 0) AS with_hit, count(*) FILTER (n > 0) / count(*)::DOUBLE AS success_rate, round(sum(t) / sum(n), 6) AS mean_score FROM n""")
def search_report(spark, d):
    found = QUERIES["sim_multi_query"](spark, d)
    asked = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"))
    return stats.search_report(found, asked).withColumn("mean_score", F.round("mean_score", 6))


# --- provider answers ------------------------------------------------------------------------------


def answers(spark, d, provider: str) -> DataFrame:
    """One answer a benchmark item: (query_id, body), JSON in the provider's form, made from documents' rows."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", F.substring_index("text", "\n", 1).alias("line"))
    link = F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org/"), F.col("doc_id").cast("string"))
    full = F.when(F.col("doc_id") % 5 != 0, F.col("line"))
    if provider == "google":
        item = F.to_json(F.struct(full.alias("title"), link.alias("link"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("displayLink"), F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("snippet"), F.col("doc_id").alias("rank")))
        wrap = lambda c: F.concat(F.lit('{"items":['), F.array_join(c, ","), F.lit("]}"))
    elif provider == "tavily":
        item = F.to_json(F.struct(full.alias("title"), link.alias("url"), F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("content"), (F.col("doc_id") % 10 / F.lit(10.0)).alias("score")))
        wrap = lambda c: F.concat(F.lit('{"response_time":"1.5","results":['), F.array_join(c, ","), F.lit("]}"))
    else:
        item = F.to_json(F.struct(full.alias("title"), link.alias("url"), F.when(F.col("doc_id") % 2 == 0, F.lit("")).otherwise(F.col("lang")).alias("source"), F.when(F.col("doc_id") % 3 == 0, F.struct(F.col("lang").alias("name"))).alias("profile")))
        wrap = lambda c: F.concat(F.lit('{"web":{"results":['), F.array_join(c, ","), F.lit("]}}"))
    rows = docs.withColumn("query_id", F.floor(F.col("doc_id") / 10)).withColumn("item", item)
    per = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("doc_id", "item"))).alias("c"))
    return per.select("query_id", wrap(F.transform("c", lambda x: x["item"])).alias("body"))


_LINE = "split_part(text, chr(10), 1)"
_LINK = "'https://' || source || '.example.org/' || doc_id"
_ORDINAL = "(row_number() OVER (PARTITION BY doc_id // 10 ORDER BY doc_id) - 1)::INT"


@query(f"SELECT doc_id // 10 AS query_id, {_ORDINAL} AS ordinal, {_LINE} AS title, {_LINK} AS link, CASE WHEN doc_id % 2 = 0 THEN source ELSE source || '.example.org' END AS display_link, CASE WHEN doc_id % 3 = 0 THEN lang ELSE '' END AS snippet, doc_id::VARCHAR AS rank FROM documents WHERE doc_id % 5 <> 0")
def json_items_google(spark, d):
    """Incomplete items are dropped, other fields kept."""
    items = providers.explode_items(answers(spark, d, "google"), "google")
    return items.select("query_id", "ordinal", "title", "link", "display_link", "snippet", F.col("extra")["rank"].alias("rank"))


@query(f"SELECT doc_id // 10 AS query_id, {_ORDINAL} AS ordinal, {_LINE} AS title, {_LINK} AS link, CASE WHEN doc_id % 3 = 0 THEN lang WHEN doc_id % 2 = 0 THEN source || '.example.org' ELSE lang END AS display_link, 'web' AS result_type FROM documents WHERE doc_id % 5 <> 0 AND {_LINE} <> ''")
def json_items_brave(spark, d):
    """Empty strings count as missing in the display link."""
    items = providers.explode_items(answers(spark, d, "brave"), "brave")
    return items.select("query_id", "ordinal", "title", "link", "display_link", F.col("extra")["resultType"].alias("result_type"))


@query(f"SELECT doc_id // 10 AS query_id, {_ORDINAL} AS ordinal, {_LINE} AS title, {_LINK} AS link, source || '.example.org' AS display_link, CASE WHEN doc_id % 3 = 0 THEN lang ELSE '' END AS snippet, doc_id % 10 / 10.0::DOUBLE AS score, 1.5::DOUBLE AS response_time FROM documents WHERE doc_id % 5 <> 0 AND {_LINE} <> ''")
def json_items_tavily(spark, d):
    a = answers(spark, d, "tavily").withColumn("response_time", providers.tavily_response_time(F.col("body")))
    items = providers.explode_items(a, "tavily")
    return items.select("query_id", "ordinal", "title", "link", "display_link", "snippet", F.col("extra")["score"].cast("double").alias("score"), "response_time")


@query("""SELECT item_id AS query_id, o.ordinal, o.title, 'https://x.org/' || o.path || '/' || item_id AS link, o.snippet FROM benchmark,
(VALUES (0, 'Head', 'abs', 'Abstract one. And more.'), (1, 'First.', 'r', 'First. Rest of it'), (2, 'Nested a', 'na', 'Nested a'), (3, 'Deep b!', 'nb', 'Deep b! more')) AS o(ordinal, title, path, snippet)""")
def json_items_duckduckgo(spark, d):
    """The abstract, results, then related topics; nested topics in their place."""
    u = lambda p: F.concat(F.lit(f"https://x.org/{p}/"), F.col("item_id").cast("string"))
    t = lambda p, text: F.struct(u(p).alias("FirstURL"), F.lit(text).alias("Text"))
    body = F.to_json(F.struct(F.lit("Head").alias("Heading"), u("abs").alias("AbstractURL"), F.lit("Abstract one. And more.").alias("AbstractText"), F.array(t("r", "First. Rest of it")).alias("Results"), F.array(F.struct(F.array(F.struct(u("na").alias("FirstURL"), F.lit("Nested a").alias("Text"), F.lit(None).cast("array<struct<FirstURL:string,Text:string>>").alias("Topics")), F.struct(F.lit(None).cast("string").alias("FirstURL"), F.lit(None).cast("string").alias("Text"), F.array(t("nb", "Deep b! more"), t("nc", "")).alias("Topics"))).alias("Topics"))).alias("RelatedTopics")))
    a = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "item_id").select("query_id", body.alias("body"))
    return providers.explode_items(a, "duckduckgo").select("query_id", "ordinal", "title", "link", "snippet")


@query("SELECT doc_id // 10 AS query_id, count(*)::INT AS n, false AS has_raw FROM documents WHERE doc_id % 5 <> 0 GROUP BY 1")
def minimal_projection(spark, d):
    items = answers(spark, d, "google").select("query_id", providers.minimal(providers.google_items(F.col("body"))).alias("items"))
    return items.filter(F.size("items") > 0).select("query_id", F.size("items").alias("n"), F.contains(F.to_json("items"), F.lit('"raw":')).alias("has_raw"))


@query(f"""SELECT event_id, 'q' || event_id AS q, least(greatest((event_id % 30)::INT, 1), 10)::VARCHAR AS num, CASE {_RANGE} WHEN 'day' THEN 'd1' WHEN 'week' THEN 'w1' WHEN 'month' THEN 'm1' WHEN 'year' THEN 'y1' END AS date_restrict,
CASE WHEN event_id % 2 = 0 THEN 'news' END AS result_filter, CASE WHEN event_id % 2 = 0 THEN 'news' ELSE 'general' END AS topic FROM events""")
def provider_requests(spark, d):
    e = table(spark, d, "events")
    span = F.element_at(F.array(*[F.lit(x) for x in ("day", "week", "month", "year", "other")]), (F.col("event_id") % 5 + 1).cast("int"))
    args = dict(query=F.concat(F.lit("q"), F.col("event_id").cast("string")), results=(F.col("event_id") % 30).cast("int"), time_range=span, topic=F.when(F.col("event_id") % 2 == 0, "news"))
    rows = e.select("event_id", *[providers.request_parameters(p, **args).alias(p) for p in ("google", "brave", "tavily")])
    return rows.select("event_id", F.col("google")["q"].alias("q"), F.col("google")["num"].alias("num"), F.col("google")["dateRestrict"].alias("date_restrict"), F.col("brave")["result_filter"].alias("result_filter"), F.col("tavily")["topic"].alias("topic"))


@query("SELECT event_id, json_extract_string(props, '$.page') AS page, regexp_replace(props, '[ \\n]+', '', 'g') AS props FROM events")
def event_properties(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.get_json_object("props", "$.page").alias("page"), F.regexp_replace("props", "[ \n]+", "").alias("props"))


# --- whole documents: parsers, chunks, plans -------------------------------------------------------


@query()
def extract_cascade(spark, d):
    return extract_pages(table(spark, d, "pages")).select("url", "title", "method", "note", "lang", "excerpt", "section_paths", F.length("text").alias("text_length"), hashing.content_hash(F.col("markdown")).alias("markdown_hash"))


@query()
def html_to_markdown(spark, d):
    return pages_to_markdown(table(spark, d, "pages"))


@query("SELECT doc_id, len(regexp_extract_all(text, '(?m)^(?:[*-] .+\\n)*[*-] .+$'))::INT AS n_lists, len(regexp_extract_all(text, '(?m)^#{1,6} +[^ \\n].*$'))::INT AS n_headings, (len(regexp_extract_all(text, '" + S + "+')) + 1)::INT AS words FROM documents")
def semantic_info(spark, d):
    found = markdown_structure(table(spark, d, "documents").select("doc_id", F.col("text").alias("markdown")))
    return found.select("doc_id", F.size("structure.lists").alias("n_lists"), F.size("structure.headings").alias("n_headings"), F.col("structure.word_count").alias("words"))


def document_chunks(spark, d) -> DataFrame:
    docs = table(spark, d, "documents")
    heading = F.concat(F.lit("# "), F.col("source"), F.lit("\n\n## "), F.col("lang"), F.lit("\n\n"), F.col("text"))
    return chunk_documents(docs.select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("url"), heading.alias("markdown")))


@query()
def chunk_text(spark, d):
    return document_chunks(spark, d)


def line_chunks(spark, d) -> DataFrame:
    """Stored chunks that SQL can make too: the lines of the documents."""
    docs = table(spark, d, "documents")
    rows = docs.select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("url"), F.col("lang").alias("section_path"), F.posexplode(F.split("text", "\n", -1)).alias("chunk_index", "text"))
    key = F.concat_ws("|", "url", F.col("chunk_index").cast("string"), "text")
    return rows.select("url", "chunk_index", hashing.content_hash(key).alias("id"), "text", "section_path", tx.token_estimate(F.col("text")).alias("tokens"))


_LINES = f"""SELECT url, (i - 1)::INT AS chunk_index, sha256(url || '|' || (i - 1) || '|' || s[i]) AS id, s[i] AS text, section_path, ceil({_JS_LENGTH.format(t="s[i]")} / 4.0::DOUBLE)::INT AS tokens
FROM (SELECT url, s, section_path, unnest(range(1, len(s) + 1)) AS i FROM (SELECT 'doc:' || doc_id AS url, string_split(text, chr(10)) AS s, lang AS section_path FROM documents))"""


@query(f"""SELECT count(*) AS chunks, coalesce(sum(tokens), 0)::BIGINT AS total_tokens, round(coalesce(avg(tokens), 0), 9) AS mean_tokens, coalesce(sum(tokens % 7), 0)::BIGINT AS total_overlap,
round(coalesce(avg(tokens % 7), 0), 9) AS mean_overlap FROM ({_LINES})""")
def chunk_overlap_stats(spark, d):
    """The report over stored chunks whose overlap is given."""
    out = stats.chunk_report(line_chunks(spark, d).withColumn("overlap_tokens", F.col("tokens") % 7))
    return out.withColumns({c: F.round(c, 9) for c in ("mean_tokens", "mean_overlap")})


def embedded_chunks(spark, d) -> DataFrame:
    c = document_chunks(spark, d)
    return embed_column(c.select("url", "id", stored_path(F.col("section_path")).alias("section_path"), "text", "tokens", "chunk_index"), HashProvider())


def logged_queries(spark, d) -> DataFrame:
    """Every benchmark item asks every document whose id has its remainder by the number of items."""
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    n = F.lit(b.count() or 1)
    docs = table(spark, d, "documents").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("url"), (F.col("doc_id") % n).alias("query_id"))
    return docs.join(F.broadcast(b) if b.count() < 100_000 else b, "query_id")


@query()
def read_from_page_query(spark, d):
    """Scoped search of each query, threshold, consolidation."""
    return read_page.answer(logged_queries(spark, d), embedded_chunks(spark, d), HashProvider(), threshold=0.2)


@query(f"SELECT url, chunk_index, id, text, section_path, NULL::DOUBLE AS score FROM ({_LINES})")
def read_from_page_all(spark, d):
    return read_page.all_chunks(line_chunks(spark, d))


_KEYWORDS = f"""n AS (SELECT count(*) AS n FROM benchmark),
asked AS (SELECT b.item_id AS query_id, d.doc_id, 'doc:' || d.doc_id AS url, b.text AS query FROM documents d, n JOIN benchmark b ON d.doc_id % n.n = b.item_id),
q AS (SELECT query_id, url, regexp_split_to_array(lower(trim(query)), '\\s+') AS terms FROM asked WHERE regexp_matches(query, '\\S')),
hit AS (SELECT q.query_id, c.* FROM q JOIN ({_LINES}) c ON c.url = q.url WHERE len(list_filter(q.terms, lambda t: contains(lower(c.text), t))) > 0),
found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, url ORDER BY chunk_index, id) AS rank FROM hit) WHERE rank <= 8)"""


@query(f"WITH {_KEYWORDS} SELECT query_id, url, rank::INT AS rank, id, 0.5::DOUBLE AS score FROM found")
def read_from_page_keywords(spark, d):
    """The fallback without vectors."""
    return read_page.keyword_answer(logged_queries(spark, d), line_chunks(spark, d)).select("query_id", "url", "rank", "id", "score")


@query(f"""WITH {_KEYWORDS},
lists AS (SELECT query_id, url, list({{'id': id, 'text': text, 'score': 0.5::DOUBLE, 'sectionPath': string_split(section_path, '|')}} ORDER BY rank) AS results FROM found GROUP BY query_id, url)
SELECT to_json({{'requestId': a.doc_id, 'url': a.url || '#in', 'lastCrawled': '2024-01-01T00:00:00.000Z', 'queries': [{{'query': a.query, 'results': coalesce(l.results, [])}}]}})::VARCHAR AS json
FROM asked a LEFT JOIN lists l ON l.query_id = a.query_id AND l.url = a.url""")
def response_envelope(spark, d):
    """The response of each document that is asked something, as JSON."""
    asked = logged_queries(spark, d)
    found = read_page.keyword_answer(asked, line_chunks(spark, d))
    requests = asked.select(F.substring_index("url", ":", -1).cast("long").alias("request_id"), F.concat("url", F.lit("#in")).alias("url_in"), "url", "query_id", "query")
    docs = asked.select("url", F.lit(None).cast("string").alias("title"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("last_crawled"), F.lit(None).cast("string").alias("note"))
    rows = envelope.page_responses(requests, found.withColumn("place", F.col("rank")), docs)
    return envelope.to_json(rows, pretty=False)


@query()
def consolidate_topk(spark, d):
    """Overlapping chunks of each document, scored by their place, the first thirty of it merged."""
    c = document_chunks(spark, d)
    rows = c.select(F.lit(0).cast("long").alias("query_id"), "url", F.col("chunk_index").alias("rank"), "id", "text", (1 / (F.col("chunk_index") + 1.0)).alias("score"), stored_path(F.col("section_path")).alias("section_path"))
    return consolidate_results(rows, most=read_page.SEARCH_RESULTS)


@query()
def page_ingest(spark, d):
    """Pages to the rows of the store: canonical url, extraction, chunks, vectors."""
    _, chunks = read_page.ingest(table(spark, d, "pages").select("url", "html"), HashProvider())
    return chunks.select("url", "chunk_index", "id", "section_path", "tokens", F.size("embedding").alias("dim"), "error")


@query()
def web_search(spark, d):
    items = result_items(spark, d).select("query_id", "ordinal", "link")
    b = table(spark, d, "benchmark").select("item_id", F.col("text").alias("query"))
    n = F.lit(b.count() or 1)
    asked = items.select("query_id").distinct()
    queries = asked.join(b, F.col("query_id") % n == F.col("item_id")).select("query_id", "query")  # texts come again where there are more queries
    out = ws.web_search(items, queries, table(spark, d, "pages").select("url", "html"), HashProvider(), threshold=0.1)
    return out.select("query_id", "ordinal", "link", F.coalesce(F.size("relevant_chunks"), F.lit(0)).alias("n_chunks"), F.to_json("relevant_chunks").alias("relevant_chunks"))
