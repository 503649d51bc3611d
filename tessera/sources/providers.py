"""Search providers: request parameters, and answers as JSON text to item rows, natively.

Items: struct(title, link, display_link, snippet, formatted_url, extra map of JSON values, raw JSON).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigurationError
from ..functions import misc, text, urls

_GOOGLE = "items array<string>"
_BRAVE_ITEM = "struct<title:string,url:string,description:string,source:string,age:string,page_age:string,profile:struct<name:string>>"
_TAVILY_ITEM = "struct<title:string,url:string,content:string,score:double,published_date:string,favicon:string,raw_content:string>"
#: Levels of nested topics that are read.
TOPIC_DEPTH = 4


def _or(*values):
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values[:-1]], values[-1])


def _item(title, link, display, snippet, formatted, raw, **extra):
    pairs = [x for k, v in extra.items() for x in (F.lit(k), v.cast("string"))]
    more = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")
    return F.struct(title.alias("title"), link.alias("link"), display.alias("display_link"), snippet.alias("snippet"), formatted.alias("formatted_url"), more.alias("extra"), raw.alias("raw"))


def google_items(body):
    """Items whose link and title are strings."""
    items = F.from_json(body, _GOOGLE)["items"]
    field = lambda i, n: F.get_json_object(i, f"$.{n}")
    whole = lambda i: F.from_json(i, "map<string,string>")
    known = ["title", "link", "displayLink", "snippet", "formattedUrl"]
    kept = F.filter(items, lambda i: field(i, "link").isNotNull() & field(i, "title").isNotNull())
    return F.transform(
        kept,
        lambda i: F.struct(
            field(i, "title").alias("title"),
            field(i, "link").alias("link"),
            F.coalesce(field(i, "displayLink"), urls.display_link(field(i, "link"))).alias("display_link"),
            F.coalesce(field(i, "snippet"), F.lit("")).alias("snippet"),
            F.coalesce(field(i, "formattedUrl"), field(i, "link")).alias("formatted_url"),
            F.map_filter(whole(i), lambda k, v: ~k.isin(known)).alias("extra"),
            i.alias("raw"),
        ),
    )


def brave_items(body):
    """Web results, then news results, each marked; '' counts as missing."""
    parsed = F.from_json(body, f"web struct<results:array<{_BRAVE_ITEM}>>, news struct<results:array<{_BRAVE_ITEM}>>")

    def part(kind):
        rows = F.coalesce(parsed[kind]["results"], F.array().cast(f"array<{_BRAVE_ITEM}>"))
        rows = F.filter(rows, lambda r: (F.length(r["url"]) > 0) & (F.length(r["title"]) > 0))
        return F.transform(rows, lambda r: _item(r["title"], r["url"], _or(r["profile"]["name"], r["source"], urls.display_link(r["url"])), F.coalesce(r["description"], F.lit("")), r["url"], F.to_json(r), resultType=F.lit(kind), source=r["source"], age=_or(r["age"], r["page_age"])))

    return F.concat(part("web"), part("news"))


def tavily_items(body):
    rows = F.coalesce(F.from_json(body, f"results array<{_TAVILY_ITEM}>")["results"], F.array().cast(f"array<{_TAVILY_ITEM}>"))
    rows = F.filter(rows, lambda r: (F.length(r["url"]) > 0) & (F.length(r["title"]) > 0))
    return F.transform(rows, lambda r: _item(r["title"], r["url"], urls.display_link(r["url"]), F.coalesce(r["content"], F.lit("")), r["url"], F.to_json(r), score=r["score"], publishedDate=r["published_date"], favicon=r["favicon"], rawContent=r["raw_content"]))


def tavily_response_time(body):
    """A number, also where the answer has it as text."""
    return F.get_json_object(body, "$.response_time").try_cast("double")


def duckduckgo_items(body, limit: int = misc.DEFAULT_RESULTS):
    """The abstract first, then topics with nested ones in place; ``limit`` bounds topics and all."""
    limit = min(max(limit, 1), misc.MOST_RESULTS["duckduckgo"])
    topic = "struct<FirstURL:string,Text:string,Result:string>"
    for _ in range(TOPIC_DEPTH):
        topic = f"struct<FirstURL:string,Text:string,Result:string,Topics:array<{topic}>>"
    parsed = F.from_json(body, f"AbstractURL string, AbstractText string, Heading string, Results array<{topic}>, RelatedTopics array<{topic}>")
    leaf = lambda t: F.struct(t["FirstURL"].alias("FirstURL"), t["Text"].alias("Text"), t["Result"].alias("Result"))
    flat = "array<struct<FirstURL:string,Text:string,Result:string>>"

    def leaves(topics, depth):
        if depth == 0:
            return F.transform(topics, leaf)
        return F.flatten(F.transform(topics, lambda t: F.when(t["Topics"].isNotNull(), leaves(t["Topics"], depth - 1)).otherwise(F.array(leaf(t)))))

    none = F.array().cast(flat)
    topics = F.concat(F.coalesce(leaves(parsed["Results"], TOPIC_DEPTH), none), F.coalesce(leaves(parsed["RelatedTopics"], TOPIC_DEPTH), none))
    topics = F.slice(F.filter(topics, lambda t: (F.length(t["FirstURL"]) > 0) & (F.length(t["Text"]) > 0)), 1, limit)
    items = F.transform(topics, lambda t: _item(_or(text.first_sentence(t["Text"]), t["Text"]), t["FirstURL"], urls.display_link(t["FirstURL"]), t["Text"], t["FirstURL"], F.to_json(t)))
    abstract = _item(_or(parsed["Heading"], text.first_sentence(parsed["AbstractText"])), parsed["AbstractURL"], urls.display_link(parsed["AbstractURL"]), parsed["AbstractText"], parsed["AbstractURL"], F.to_json(F.struct(parsed["AbstractURL"].alias("AbstractURL"), parsed["AbstractText"].alias("AbstractText"), parsed["Heading"].alias("Heading"))))
    has = (F.length(parsed["AbstractURL"]) > 0) & (F.length(parsed["AbstractText"]) > 0)
    return F.slice(F.concat(F.filter(F.array(abstract), lambda a: F.coalesce(has, F.lit(False))), items), 1, limit)


ITEMS = {"google": google_items, "brave": brave_items, "tavily": tavily_items, "duckduckgo": duckduckgo_items}


def items_of(provider: str):
    """The function from an answer's JSON to its items."""
    if provider not in ITEMS:
        raise ConfigurationError(f"unknown search provider: {provider}")
    return ITEMS[provider]


def request_parameters(provider: str, query, results=None, time_range=None, topic=None, depth=None):
    """A map column with what the provider is asked."""
    items_of(provider)
    n = misc.clamp(results if results is not None else F.lit(None).cast("int"), misc.MOST_RESULTS[provider]).cast("string")
    span = time_range if time_range is not None else F.lit(None).cast("string")
    about = topic if topic is not None else F.lit(None).cast("string")
    pairs = {
        "google": {"q": query, "num": n, "dateRestrict": misc.time_range("google", span)},
        "brave": {"q": query, "count": n, "freshness": misc.time_range("brave", span), "result_filter": F.when(about == "news", "news")},
        "duckduckgo": {"q": query, "format": F.lit("json"), "no_html": F.lit("1"), "skip_disambig": F.lit("1")},
        "tavily": {"query": query, "topic": F.coalesce(about, F.lit("general")), "search_depth": F.coalesce(depth if depth is not None else F.lit(None).cast("string"), F.lit("basic")), "max_results": n, "time_range": span},
    }[provider]
    return F.map_filter(F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())


def explode_items(answers: DataFrame, provider: str, body: str = "body", **options) -> DataFrame:
    """A row an item, with its ordinal from 0, of rows (..., body)."""
    rest = [c for c in answers.columns if c != body]
    return answers.select(*rest, F.posexplode(items_of(provider)(F.col(body), **options)).alias("ordinal", "item")).select(*rest, "ordinal", "item.*")


def minimal(items):
    """Items without their raw part."""
    return F.transform(items, lambda i: i.dropFields("raw"))


def union_ordered(parts: list[DataFrame]) -> DataFrame:
    """Rows of all parts, with the part's number, so that their order can be had back."""
    return reduce(lambda a, b: a.unionByName(b), [p.withColumn("part", F.lit(k)) for k, p in enumerate(parts)])
