"""More of the catalogue: the store's life, live sources with a stand-in for the network, and known answers of the document core.

The cores that parse, cut and merge texts are beyond SQL. Their queries run over a few stated documents, and their
SQL states what must come out.
"""

from __future__ import annotations

import gzip
import tempfile
import uuid
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import from_environment
from ..errors import EmbeddingError, NetworkError, TesseraError
from ..functions import misc
from ..markup import chunking
from ..operators.chunking import chunk_documents
from ..operators.consolidation import checked_limit, consolidate_results
from ..operators.extraction import extract_pages, pages_to_markdown
from ..session import table
from ..sources import embeddings, http, providers
from ..sources.store import DOCUMENTS, Store
from . import envelope, read_page
from .catalog import _KEYWORDS, line_chunks, literal_rows, logged_queries, query

# --- store -----------------------------------------------------------------------------------------


def _folder(spark) -> str:
    sc = spark.sparkContext
    given = sc.getConf().get("spark.checkpoint.dir")
    if not given and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{given or tempfile.mkdtemp(prefix='tessera-store-')}/store-{uuid.uuid4().hex}"


_EXPIRED = "2024-01-20 00:00:00"


@query(f"""WITH c AS (SELECT vec_id, 'http://u/' || (vec_id % 40) AS url, vec_id % 100 AS tokens FROM embeddings),
kept AS (SELECT * FROM c WHERE vec_id <> 7 AND (url <> 'http://u/3' OR vec_id % 80 = 3)),
d AS (SELECT * FROM (SELECT 'http://u/' || user_id AS url, event_type AS title, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC, event_id::VARCHAR DESC) AS n FROM events) WHERE n = 1 AND url <> 'http://u/5')
SELECT d.url, title, strftime(ts, '%Y-%m-%d %H:%M:%S') AS last_crawled, event_id::VARCHAR AS content_hash, count(k.vec_id) AS chunk_count, coalesce(sum(k.tokens), 0)::BIGINT AS total_tokens
FROM d LEFT JOIN kept k ON k.url = d.url WHERE ts >= '{_EXPIRED}' GROUP BY ALL""")
def store_lifecycle(spark, d):
    """A store through its life: keyed upserts of repeated keys, a replaced page, deletions, retention, compaction, reopening."""
    from .stats import per_document

    root = _folder(spark)
    s = Store(spark, root, "model one", 2)
    e = table(spark, d, "events")
    none = lambda c: F.lit(None).cast("string").alias(c)
    rows = e.select(F.concat(F.lit("http://u/"), F.col("user_id").cast("string")).alias("url"), F.col("event_type").alias("title"), none("etag"), none("last_modified"), F.col("ts").cast("timestamp").alias("last_crawled"), F.col("event_id").cast("string").alias("content_hash"))
    s.upsert_documents(rows)
    v = table(spark, d, "embeddings")
    url = F.concat(F.lit("http://u/"), (F.col("vec_id") % 40).cast("string")).alias("url")
    pieces = v.select(F.col("vec_id").cast("string").alias("id"), url, none("section_path"), F.lit("text").alias("text"), (F.col("vec_id") % 100).cast("int").alias("tokens"), F.slice("embedding", 1, 2).alias("embedding"), F.col("vec_id").cast("int").alias("chunk_index"))
    s.upsert_chunks(pieces.unionByName(pieces))
    s.upsert_chunks(pieces.filter("url = 'http://u/3' and cast(id as long) % 80 = 3"), replace=True)
    s.delete_chunk("7")
    s.delete_document("http://u/5")
    s.delete_expired(F.lit(_EXPIRED).cast("timestamp"))
    s.compact()
    again = Store(spark, root, "model one", 2)
    out = per_document(again.documents, again.chunks)
    return out.select("url", "title", F.date_format("last_crawled", "yyyy-MM-dd HH:mm:ss").alias("last_crawled"), "content_hash", "chunk_count", F.col("total_tokens").cast("long").alias("total_tokens"))


@query("""SELECT * FROM (VALUES ('another model', 'configuration'), ('the same model', 'ok'), ('another dimension empties', '0'), ('wrong dimension', 'database'), ('cleared', '0'), ('by url', '1'), ('has bytes', 'true')) AS t(name, result)""")
def store_guards(spark, d):
    """What a store refuses, and what it holds afterwards."""
    root = _folder(spark)
    s = Store(spark, root, "m", 2)
    one = spark.createDataFrame([("a", "u", None, "x", 1, [1.0, 0.5], 0)], "id string, url string, section_path string, text string, tokens int, embedding array<float>, chunk_index int")
    s.upsert_chunks(one)
    s.upsert_documents(spark.createDataFrame([("u", "t", None, None, None, "h")], DOCUMENTS))

    def other():
        s._write("meta", spark.createDataFrame([("embedding_model", "other")], "key string, value string"), "key string, value string")
        Store(spark, root, "m", 2)

    rows = [("by url", str(s.document("u").count())), ("has bytes", str(s.size_bytes() > 0).lower())]
    rows += [("the same model", _outcome(lambda: Store(spark, root, "m", 2)))]
    rows += [("wrong dimension", _outcome(lambda: s.upsert_chunks(one.withColumn("embedding", F.array(F.lit(1.0).cast("float"))))))]
    rows += [("another dimension empties", str(Store(spark, root, "m", 3).chunks.count()))]
    s.clear_configuration()
    rows += [("cleared", str(s.meta.count())), ("another model", _outcome(other))]
    return literal_rows(spark, rows, "name string, result string")


def _outcome(run) -> str:
    """``ok``, or the kind of the error."""
    try:
        run()
    except TesseraError as e:
        return e.kind
    except ValueError:
        return "value"
    return "ok"


# --- live sources, over a stand-in for the network -------------------------------------------------


def _site(method: str, url: str, headers: dict, body: bytes | None, timeout: float):
    """Answers by the last digit of the path."""
    kind = int(url.rpartition("/")[2]) % 7
    if kind == 1 and headers.get("if-none-match"):
        return 304, {"etag": headers["if-none-match"]}, b""
    if kind == 2:
        return 404, {}, b""
    if kind == 3:
        return 302, {"location": "/0"}, b""
    if kind == 4:
        return 302, {"location": url}, b""
    if kind == 5:
        raise OSError("unreachable")
    if kind == 6:
        return 200, {"content-encoding": "deflate"}, zlib.compress("déflate".encode())
    return 200, {"content-encoding": "gzip", "etag": "e0"}, gzip.compress(b"zipped")


@query("""SELECT page_id, CASE page_id % 7 WHEN 1 THEN 304 WHEN 0 THEN 200 WHEN 3 THEN 200 WHEN 6 THEN 200 END::INT AS status,
CASE page_id % 7 WHEN 0 THEN 'zipped' WHEN 3 THEN 'zipped' WHEN 1 THEN '' WHEN 6 THEN 'déflate' END AS body,
CASE page_id % 7 WHEN 0 THEN 'e0' WHEN 3 THEN 'e0' WHEN 1 THEN 'e1' END AS etag, page_id % 7 = 1 AS not_modified, page_id % 7 IN (2, 4, 5) AS failed FROM pages""")
def http_pages(spark, d):
    """Every page fetched: encodings, redirects, validators, and failures that stay rows."""
    p = table(spark, d, "pages")
    url = F.concat(F.lit("http://h/"), F.col("page_id").cast("string"))
    got = http.fetch_pages(p.select(url.alias("url"), F.when(F.col("page_id") % 7 == 1, "e1").alias("etag"), F.lit(None).cast("string").alias("last_modified")), transport=_site, concurrency=4)
    got = http.require_some(got)
    return got.select(F.substring_index("url", "/", -1).cast("long").alias("page_id"), "status", "body", "etag", "not_modified", F.col("error").isNotNull().alias("failed"))


class Lengths:
    """An embedding model of three numbers: length, its last digit, and the first character."""

    model = "lengths"

    def embed(self, texts: list[str]) -> list[list[float]]:
        if any(len(t) % 50 == 49 for t in texts):
            raise EmbeddingError("refused", 500)
        return [[len(t) / 100, len(t) % 10 / 10, ord(t[0]) / 1000 if t else 0.0] for t in texts]


@query("""SELECT doc_id, CASE WHEN length(text) % 50 <> 49 THEN round(length(text) / 100.0::DOUBLE, 3) END AS a, CASE WHEN length(text) % 50 <> 49 THEN round(length(text) % 10 / 10.0::DOUBLE, 3) END AS b,
CASE WHEN length(text) % 50 <> 49 THEN round(unicode(text) / 1000.0::DOUBLE, 3) END AS c, length(text) % 50 = 49 AS failed FROM documents WHERE length(text) < 2000 AND length(text) > 0""")
def embed_texts(spark, d):
    """Texts with their vectors; a refused request leaves its rows without one."""
    docs = table(spark, d, "documents").select("doc_id", "text").filter("length(text) < 2000 and length(text) > 0")
    got = embeddings.embed_column(docs, Lengths(), batch=1)
    part = lambda i, n: F.round(F.get("embedding", F.lit(i)).cast("double"), 3).alias(n)
    return got.select("doc_id", part(0, "a"), part(1, "b"), part(2, "c"), F.col("error").isNotNull().alias("failed"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Content could not be embedded: down' WHEN doc_id % 2 = 0 THEN 'own' END AS note FROM documents""")
def embedding_notes(spark, d):
    """Documents whose chunks have no vectors are kept, with a note."""
    url = F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("url")
    docs = table(spark, d, "documents").select("doc_id", url, F.when(F.col("doc_id") % 2 == 0, "own").alias("note"))
    c = line_chunks(spark, d).withColumn("error", F.when((F.substring_index("url", ":", -1).cast("long") % 3 == 0) & (F.col("chunk_index") == 0), "down"))
    return envelope.with_embedding_notes(docs, c.select("url", "error")).select("doc_id", "note")


@query(f"""WITH {_KEYWORDS} SELECT query_id, url, '2024-02-01' AS last_crawled, count(*)::INT AS n, string_agg(id, ',' ORDER BY rank) AS ids, min(section_path) AS first_path FROM found GROUP BY query_id, url""")
def references(spark, d):
    """A document's matches as one nested row."""
    found = read_page.keyword_answer(logged_queries(spark, d), line_chunks(spark, d)).withColumn("place", F.col("rank"))
    docs = found.select("url").distinct().withColumn("last_crawled", F.lit("2024-02-01 00:00:00").cast("timestamp"))
    out = read_page.references(found, docs)
    ids = F.array_join(F.transform("relevant_chunks", lambda c: c["id"]), ",")
    return out.select("query_id", "url", F.date_format("last_crawled", "yyyy-MM-dd").alias("last_crawled"), F.size("relevant_chunks").alias("n"), ids.alias("ids"), F.col("relevant_chunks")[0]["section_path"][0].alias("first_path"))


# --- limits, errors and small functions ------------------------------------------------------------


@query("""SELECT * FROM (VALUES ('results 0', 'validation'), ('results 1', 'ok'), ('results 50', 'ok'), ('results 51', 'validation'), ('provider unknown', 'configuration'), ('provider known', 'ok'), ('embedding provider unknown', 'configuration'),
('settings missing', 'configuration'), ('concurrency 11', 'configuration'), ('concurrency 10', 'ok'), ('scheme', 'validation'), ('status 404', 'network'), ('redirects', 'network'), ('days -1', 'value'), ('batch 33', 'value')) AS t(name, result)""")
def limits_and_errors(spark, d):
    """What is refused, and with which kind of error."""
    given = {"EMBEDDING_SERVER_URL": "http://e", "EMBEDDING_SERVER_API_KEY": "k", "EMBEDDING_MODEL_NAME": "m", "SEARCH_PROVIDER": "duckduckgo"}
    rows = table(spark, d, "benchmark").select("text")
    cases = {f"results {k}": lambda k=k: checked_limit(k) for k in (0, 1, 50, 51)}
    cases |= {"provider unknown": lambda: providers.items_of("x"), "provider known": lambda: providers.items_of("brave"), "embedding provider unknown": lambda: embeddings.provider("x")}
    cases |= {"settings missing": lambda: from_environment({}), "concurrency 11": lambda: from_environment(given | {"CONCURRENCY": "11"}), "concurrency 10": lambda: from_environment(given | {"CONCURRENCY": "10"})}
    cases |= {"scheme": lambda: http.fetch("ftp://h/0", transport=_site), "status 404": lambda: http.fetch("http://h/2", transport=_site), "redirects": lambda: http.fetch("http://h/4", transport=_site)}
    cases |= {"days -1": lambda: misc.cutoff(F.current_timestamp(), -1), "batch 33": lambda: embeddings.embed_column(rows, Lengths(), batch=33)}
    return literal_rows(spark, [(name, _outcome(run)) for name, run in cases.items()], "name string, result string")


@query("""SELECT * FROM (VALUES ('bytes 0', '0 Bytes'), ('bytes 1023', '1023 Bytes'), ('bytes 1536', '1.5 KB'), ('bytes 1048576', '1 MB'), ('bytes 5368709120', '5 GB'), ('redacted', '{''apiKey'': ''[REDACTED]'', ''q'': ''x'', ''in'': {''token'': ''[REDACTED]'', ''n'': 1}}'),
('cutoff', '2024-01-01'), ('sentences', 'Dr. Smith went to the U.S. Army base|He met e.g. Mr. Jones|Then left'), ('budget', '435'), ('tokens of code', '4'), ('tokens of prose', '3'), ('paths', 'true false')) AS t(name, result)""")
def small_functions(spark, d):
    """Formats, redaction, cutoff, sentences, token budget."""
    rows = [(f"bytes {n}", misc.format_bytes(n)) for n in (0, 1023, 1536, 1048576, 5368709120)]
    rows += [("redacted", str(misc.redact({"apiKey": "s", "q": "x", "in": {"token": "t", "n": 1}})))]
    rows += [("sentences", "|".join(chunking.sentences("Dr. Smith went to the U.S. Army base. He met e.g. Mr. Jones! Then left")))]
    rows += [("budget", str(chunking.budget(512, 15))), ("tokens of code", str(chunking.tokens("a" * 10, "code"))), ("tokens of prose", str(chunking.tokens("a" * 10)))]
    two = chunking.chunk("# A\n\nOne sentence of it. Two sentences.\n\n## B\n\nThree of them. Four of them.", "u", 16)
    rows += [("paths", f"{two[0].path == ('A',)} {two[0].path == two[-1].path}".lower())]
    out = literal_rows(spark, rows, "name string, result string")
    at = F.date_format(misc.cutoff(F.lit("2024-01-31 00:00:00").cast("timestamp"), 30), "yyyy-MM-dd")
    return out.unionByName(spark.range(1).select(F.lit("cutoff").alias("name"), at.alias("result")))


# --- known answers of the document core ------------------------------------------------------------

_ARTICLE = "# Main\n\nIntro text here.\n\n## One\n\nFirst part. Second part.\n\n### Deep\n\nDeep words.\n\n```js\nlet a = 1;\n\nlet b = 2;\n```\n\n- one\n- two\n\n## Two\n\n> quoted\n> more\n\nThe end."
#: (name, markdown, most tokens, overlap, a text that must be there)
_CHUNKED = [
    ("article", _ARTICLE, 14, 15.0, "let a = 1;\n\nlet b = 2;"),
    ("two top sections", "# A\n\n" + "Alpha words stand here now. " * 12 + "\n\n# B\n\n" + "Beta words stand here too. " * 12, 400, 15.0, "Beta words"),
    ("one section, small chunks", "# A\n\n## X\n\nFirst sentence of it. Second sentence of it.\n\n## Y\n\nThird sentence of it. Fourth sentence of it.", 30, 15.0, "Fourth sentence"),
    ("no overlap asked", "# A\n\n## X\n\nFirst sentence of it. Second sentence of it.\n\n## Y\n\nThird sentence of it. Fourth sentence of it.", 30, 0.0, "Fourth sentence"),
    ("large paragraph", "# Big\n\n" + "This sentence is one of very many alike. " * 50, 50, 15.0, "very many"),
    ("unclosed fence", "# T\n" + "before the code " * 40 + "\n```python\n" + "x = 1\n" * 60 + "# Not a heading\nlater text", 100, 15.0, "later text"),
    ("plain", "Just some plain text.", 512, 15.0, "Just some plain text."),
    ("blank", " \n ", 512, 15.0, ""),
]


@query("""SELECT * FROM (VALUES ('article', true, true, 'Main', 'Main > Two', true, true, true), ('two top sections', true, false, 'A', 'B', false, true, true), ('one section, small chunks', true, false, 'A > X', 'A > Y', true, true, true),
('no overlap asked', true, false, 'A > X', 'A > Y', false, true, true), ('large paragraph', true, true, 'Big', 'Big', true, true, true), ('unclosed fence', true, false, 'T', 'T', true, false, true), ('plain', true, false, NULL, NULL, false, true, true))
AS t(name, found, many, first_path, last_path, overlapping, within, kept)""")
def chunk_goldens(spark, d):
    """Sections, whole code, overlap within a top section only, limits, fences without an end (a sentence beyond the limit stays whole); blank texts have no chunk."""
    parts = []
    for name, markdown, most, share, mark in _CHUNKED:
        c = chunk_documents(literal_rows(spark, [(name, markdown)], "url string, markdown string"), most, share)
        path = F.array_join("section_path", " > ")
        ends = lambda by: by(F.when(path != "", path), F.col("chunk_index"))
        row = c.groupBy(F.col("url").alias("name")).agg((F.count("*") > 0).alias("found"), (F.count("*") > 4).alias("many"), ends(F.min_by).alias("first_path"), ends(F.max_by).alias("last_path"), (F.max("overlap_tokens") > 0).alias("overlapping"), (F.max("tokens") <= most * 1.4).alias("within"), F.max(F.contains("text", F.lit(mark))).alias("kept"))
        parts.append(row)
    return providers.union_ordered(parts).drop("part")


_SHARED = "the shared passage of more than thirty letters"
_PROSE = "Prose explains at length what the code does and why anyone would want to run it."
_CODE = "# Title\n```python\nprint(1)\n```"
_MERGED = [
    ("one", [("a", "text", 0.5, "S")]),
    ("end meets beginning", [("1", f"First words come here and {_SHARED}", 0.92, "S"), ("2", f"{_SHARED} and then it goes on elsewhere", 0.88, "S")]),
    ("contained", [("a", "This sentence is inside of the other one.", 1.0, "S"), ("b", "This sentence is inside of the other one. And the other one has a lot more to say about it than that.", 0.8, "S")]),
    ("three sections", [("x", "Alone in the first.", 0.8, "A"), ("y", "Something else in the second.", 0.95, "B"), ("z", "Nothing like these at all.", 0.6, "C")]),
    ("little overlap", [("1", "Completely different words stand here.", 0.9, "S"), ("2", "Nothing of it appears in that one at all.", 0.8, "S")]),
    ("structure and prose", [("p", _PROSE, 0.9, "S"), ("c", _CODE, 0.8, "S")]),
    ("structure and prose apart", [("p", _PROSE, 0.9, "S"), ("c", _CODE, 0.8, "T")]),
    ("no section", [("1", "Completely different words stand here.", 0.9, None), ("2", "Nothing of it appears in that one at all.", 0.8, None)]),
    ("chain", [("1", f"one two three {_SHARED}", 0.9, "S"), ("2", f"{_SHARED} between iota kappa lambda mu nu xi omicron pi", 0.8, "S"), ("3", "iota kappa lambda mu nu xi omicron pi four five six", 0.7, "S")]),
]


@query("""SELECT * FROM (VALUES ('one', 1, 'a', 0.5::DOUBLE, 1), ('end meets beginning', 1, 'consolidated-1+2', 0.9::DOUBLE, 2), ('contained', 1, 'consolidated-a+b', 0.86::DOUBLE, 2), ('three sections', 3, 'y', 0.95::DOUBLE, 1), ('little overlap', 2, '1', 0.9::DOUBLE, 1),
('structure and prose', 1, 'consolidated-c+p', 0.87::DOUBLE, 2), ('structure and prose apart', 2, 'p', 0.9::DOUBLE, 1), ('no section', 2, '1', 0.9::DOUBLE, 1), ('chain', 1, NULL, 0.79::DOUBLE, 3)) AS t(name, rows, first_id, best_score, most_sources)""")
def consolidation_goldens(spark, d):
    """Overlaps, containment, chains and structure with prose merge within a section; scores are weighed by length."""
    rows = [(0, name, k, i, t, s, p) for name, found in _MERGED for k, (i, t, s, p) in enumerate(found)]
    out = consolidate_results(literal_rows(spark, rows, "query_id long, url string, rank int, id string, text string, score double, section_path string"))
    first = F.min_by("id", "place")
    return out.groupBy(F.col("url").alias("name")).agg(F.count("*").cast("int").alias("rows"), F.when(F.col("name") != "chain", first).alias("first_id"), F.round(F.max("score"), 2).alias("best_score"), F.max(F.size("source_ids")).alias("most_sources"))


_P = "<p>" + "This paragraph has a good number of words, commas, and some length to it. " * 4 + "</p>"
_PAGES = [
    ("article", f"<html lang=en><title>T</title><body><nav>{'menu ' * 50}</nav><article><h2>Head</h2>{_P * 3}</article><footer>Foot</footer></body></html>"),
    ("short", f"<html lang=es><body><header>Site</header><main><h1>Real</h1><p>{'word ' * 40}</p><aside>Side menu</aside></main></body></html>"),
    ("role", f'<body><div role="main"><p>{"other words " * 20}</p></div><div class="ad">menu</div></body>'),
    ("empty", "<html><head><title>Only a title</title></head><body><div id=app></div></body></html>"),
    ("raw", "<title>R</title><p>few words</p><script>menu()</script>"),
]


@query("""SELECT * FROM (VALUES ('article', 'density', 'en', 'T', false, '[Head]'), ('short', 'selectors', 'es', NULL, false, '[Real]'), ('role', 'selectors', NULL, NULL, false, '[]'), ('empty', 'raw', NULL, 'Only a title', false, '[]'), ('raw', 'raw', NULL, 'R', false, '[]')) AS t(url, method, lang, title, noise, headings)""")
def extraction_goldens(spark, d):
    """The first strategy that is good enough; navigation, advertisement and scripts are left out."""
    out = extract_pages(literal_rows(spark, _PAGES, "url string, html string"))
    return out.select("url", "method", "lang", "title", F.contains("text", F.lit("menu")).alias("noise"), F.concat(F.lit("["), F.array_join("section_paths", ", "), F.lit("]")).alias("headings"))


_HTML = [
    ("headings", "<h1>One</h1><h3>Three</h3><p>text</p>"),
    ("marks", "<p>a <strong>b</strong> <em>c</em> <code>d</code></p>"),
    ("link", '<p><a href="/x">go</a> <img src="i.png" alt="pic"></p>'),
    ("fence", '<pre><code class="language-js">let a = 1;</code></pre>'),
    ("list", "<ul><li>x<li>y</ul>"),
    ("numbers", "<ol start=3><li>x<li>y</ol>"),
    ("quote", "<blockquote><p>said</p></blockquote>"),
    ("dropped", "<nav>menu</nav><p>kept</p><script>x</script><footer>f</footer>"),
    ("rule", "<p>a</p><hr><p>b</p>"),
    ("none", ""),
]


@query(r"""SELECT name, replace(markdown, '~', chr(10)) AS markdown FROM (VALUES ('headings', '# One~~### Three~~text'), ('marks', 'a **b** *c* `d`'), ('link', '[go](/x) ![pic](i.png)'), ('fence', '```js~let a = 1;~```'), ('list', '-   x~~-   y'),
('numbers', '3.  x~4.  y'), ('quote', '> said'), ('dropped', 'kept'), ('rule', 'a~~---~~b'), ('none', '')) AS t(name, markdown)""")
def markdown_goldens(spark, d):
    """Elements as markdown."""
    return pages_to_markdown(literal_rows(spark, _HTML, "url string, html string")).select(F.col("url").alias("name"), "markdown")
