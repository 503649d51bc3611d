"""Pages to extracted text. The native cleaning runs in the JVM; the parser sees each page once."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..markup import dom
from ..markup import extract as ex
from ..markup.markdown import structure, to_markdown
from .spread import spread

STRUCTURE = "struct<headings:array<struct<level:int,text:string,position:int>>,code_blocks:array<struct<language:string,content:string,position:int,length:int>>,lists:array<struct<content:string,position:int,item_count:int>>,word_count:int,character_count:int>"
_FIELDS = ["title", "text", "markdown", "excerpt", "section_paths", "structure", "byline", "lang", "method", "note"]
SCHEMA = f"title string, text string, markdown string, excerpt string, section_paths array<string>, structure {STRUCTURE}, byline string, lang string, method string, note string"


def _arrow_structure():
    of = lambda *fields: pa.list_(pa.struct(list(fields)))
    i, s = pa.int32(), pa.string()
    return pa.struct([("headings", of(("level", i), ("text", s), ("position", i))), ("code_blocks", of(("language", s), ("content", s), ("position", i), ("length", i))), ("lists", of(("content", s), ("position", i), ("item_count", i))), ("word_count", i), ("character_count", i)])


def _kinds():
    s = pa.string()
    return [s, s, s, s, pa.list_(s), _arrow_structure(), s, s, s, s]


def _extracted(html: str | None, clean: str | None, title: str | None, shown: str | None) -> dict:
    """A page that no strategy can read is the native cleaning's text with a note, so that it doesn't end the job."""
    try:
        return ex.extract(html, clean, title, shown)
    except Exception as e:  # noqa: BLE001 - any page can be on the web
        return ex.raw(clean or "", title) | {"note": f"Extraction failed: {type(e).__name__}: {e}"[:300]}


def extract_pages(pages: DataFrame, rendered: str | None = None) -> DataFrame:
    """(url, title, text, markdown, excerpt, section_paths, structure, byline, lang, method, note) of (url, html).

    ``rendered`` names a column with the page as a browser rendered it, if a renderer filled one.
    """
    pages = spread(pages.select("url", "html", *([rendered] if rendered else [])))
    rows = pages.select("url", "html", tx.clean_html(F.col("html")).alias("_clean"), tx.html_title(F.col("html")).alias("_title"), (F.col(rendered) if rendered else F.lit(None).cast("string")).alias("_shown"))

    def run(batches):
        for b in batches:
            cells = [b.column(c).to_pylist() for c in ("html", "_clean", "_title", "_shown")]
            found = [_extracted(*c) for c in zip(*cells, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("url"), *[pa.array([f[n] for f in found], t) for n, t in zip(_FIELDS, _kinds(), strict=True)]], names=["url", *_FIELDS])

    return rows.mapInArrow(run, f"url string, {SCHEMA}")


def pages_to_markdown(pages: DataFrame) -> DataFrame:
    """(url, markdown, error) of the whole body of each page; one that can't be read has an error and no markdown."""

    def run(batches):
        for b in batches:
            out = []
            for html in b.column("html").to_pylist():
                try:
                    root = dom.parse(html or "")
                    out.append((to_markdown(next((n for n in root.walk() if n.tag == "body"), root)), None))
                except Exception as e:  # noqa: BLE001 - any page can be on the web
                    out.append((None, f"{type(e).__name__}: {e}"[:300]))
            yield pa.RecordBatch.from_arrays([b.column("url"), *[pa.array([o[k] for o in out], pa.string()) for k in (0, 1)]], names=["url", "markdown", "error"])

    return spread(pages.select("url", "html")).mapInArrow(run, "url string, markdown string, error string")


def markdown_structure(documents: DataFrame) -> DataFrame:
    """(doc_id, structure) of (doc_id, markdown)."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            found = [structure(t or "") for t in b.column("markdown").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, _arrow_structure())], names=["doc_id", "structure"])

    return spread(documents.select("doc_id", "markdown")).mapInArrow(run, f"doc_id {kind}, structure {STRUCTURE}")
