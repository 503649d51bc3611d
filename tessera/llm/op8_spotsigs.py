"""Document fingerprints by SpotSigs, native throughout.

A text's words are lower-cased runs of letters and digits. Each common word is an anchor; its chain
is the first two content words (words that aren't common) after it, past one more anchor at most;
anchor and chain, hashed to 32 bits, are a signature. The fingerprint is the set of signatures, as 8 hex
digits each, sorted. A text without an anchor has one signature, of all of its words. Two fingerprints
are compared by the Jaccard similarity of their sets.

``similar_pairs`` is the join. Sets are partitioned by length, in steps of the threshold, so that a set can
be similar only to sets of its own partition and the next lower one: it looks there, by the partition's
number and one signature. It shows its rarest signatures only (prefix filter), fewer as the smaller of
two, so that frequent ones build no large groups; then the exact similarity decides.
``similar_documents`` has a row a document: its class (equal sets) and the number of other classes that
are similar. The query of this operator compares neighbours only, as its contract says; the query
``similar_fingerprints`` runs the join over all documents.

Defined cases: null text is the empty text; the next of the last document is the first, of a single
document itself; rows with one doc_id follow each other by text, descending, and a null id comes
last; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, saved, table

CHAIN = 2

#: Common words of English, German, French and Spanish, the anchors.
COMMON_WORDS = """
a an and are as at be been but by can for from had has have he her his i if in is it its not of on or she so than that the their them there they this to was we were which who will with would you
aber als auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich im ist mit nach nicht noch nur oder sich sie sind und vom von vor war wie wird zu zum zur über
au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur lui mais ne nous où par pas plus pour qu que qui sa se ses son sont sur un une vous
al como con cuando del desde el ella entre era es esta este fue ha hay la las lo los más me mi muy no nos o para pero por que se sin sobre su sus también un una y ya
""".split()


def signatures(text):
    """The sorted distinct signatures (int) of a text column."""
    common = sorted(set(COMMON_WORDS))
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    marked = F.concat(F.array_join(F.transform(words, lambda w: F.when(w.isin(common), F.concat(F.lit("\n"), w)).otherwise(w)), " "), F.lit(" "))
    let = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    # the first 32 bits of the MD5, which SQL elsewhere has too, in the order of their hex digits
    digest = lambda t: (F.conv(F.substring(F.md5(t.cast("binary")), 1, 8), 16, 10).cast("long") - F.lit(1 << 31)).cast("int")

    def chains(parts):  # what is before the first anchor, then each anchor with what follows it
        rest = F.transform(parts, lambda p: F.substring(p, F.instr(p, " ") + 1, F.lit(1 << 30)))
        spot = lambda p, after: digest(F.rtrim(F.substring_index(F.concat(p, F.coalesce(after, F.lit(""))), " ", CHAIN + 1)))
        spots = let(rest, lambda r: F.transform(parts, lambda p, i: spot(p, F.get(r, i + 1))))
        whole = F.array(digest(F.concat(F.lit("\n"), F.array_join(parts, "\n"))))
        return F.when(F.size(parts) > 1, F.slice(spots, 2, F.greatest(F.size(parts) - 1, F.lit(1)))).otherwise(whole)

    return F.sort_array(F.array_distinct(let(F.split(marked, "\n"), chains)))


def as_text(sigs):
    return F.array_join(F.transform(sigs, lambda s: F.lower(F.lpad(F.hex(s.cast("long") + F.lit(1 << 31)), 8, "0"))), "")


def likeness(a, b):
    """Jaccard similarity of two sets of signatures."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return both / (F.size(a) + F.size(b) - both)


def with_next(documents: DataFrame, parts: int | None = None) -> DataFrame:
    """(doc_id, text, sigs, next_text, next_sigs): the next row in descending doc_id, cyclically; null texts are empty.

    Rows are dealt by ranges of ids with edges from approximate quantiles; within a range a window
    looks ahead, and the last row of a range gets the first row of the next range that has rows.
    """
    spark = documents.sparkSession
    parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    edges = rows.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], max(10_000, 10 * parts)).alias("e")).first()["e"] or []
    edges = sorted(set(edges))
    part = F.size(F.filter(F.lit(edges) if edges else F.array().cast("array<bigint>"), lambda e: e <= F.col("doc_id")))
    rows = rows.withColumn("part", F.when(F.col("doc_id").isNull(), -1).otherwise(part))

    heads = rows.groupBy("part").agg(F.max(F.struct("doc_id", "text")).alias("head"))
    cyclic = Window.orderBy(F.col("part").desc())  # one row a range
    first = F.first("head").over(cyclic)
    heads = heads.select(F.col("part").alias("of"), F.coalesce(F.lead("head").over(cyclic), first)["text"].alias("head_text"))
    heads = heads.withColumn("head_sigs", signatures(F.col("head_text")))
    ahead = Window.partitionBy("part").orderBy(F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    rows = rows.withColumn("sigs", signatures(F.col("text")))
    rows = rows.withColumn("next", F.lead(F.struct("text", "sigs")).over(ahead)).join(heads, F.col("part") == F.col("of"))
    return rows.select("doc_id", "text", "sigs", F.coalesce("next.text", "head_text").alias("next_text"), F.coalesce("next.sigs", "head_sigs").alias("next_sigs"))


def edited(text, next_text):
    """The last third of the code points replaced by as many of the next text's first."""
    n = F.length(text)
    k = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - k), F.substring(next_text, F.lit(1), k))


def _partition(n, least: float):
    """Number of a length's partition: two lengths whose ratio is ``least`` or more are at most one apart."""
    return F.floor(F.log(n.cast("double")) / F.lit(-math.log(least))).cast("int")


def similar_pairs(sets: DataFrame, least: float = 0.8) -> DataFrame:
    """(a, b, similarity) with a < b over ``sets`` (id, sigs), one row a set: all pairs at ``least`` or more.

    Equal sets should be one row, or each pair of them is a row. Of two sets, that with more signatures (n)
    shows n - ceil(least n) + 1 of them, the other one n - ceil(2 least n / (1 + least)) + 1, the rarest first.
    Key tables are written before they are joined, so that Spark can split the rows of a hot key.
    """
    sets = sets.select("id", "sigs", F.size("sigs").alias("n")).filter("n > 0")
    each = sets.select("id", "n", F.explode("sigs").alias("s"))
    counts = saved(each.groupBy("s").agg(F.count("*").alias("c")).filter("c > 1"))
    own = Window.partitionBy("id")
    # signatures of one set only come first: they are what a set has besides its shared ones
    place = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("c", "s"))
    most = lambda share: F.col("n") - F.ceil(F.col("n") * F.lit(share) - 1e-9) + 1
    keys = each.join(counts, "s").withColumn("place", place).filter(F.col("place") <= most(least))
    keys = saved(keys.select("id", "n", "s", (F.col("place") <= most(2 * least / (1 + least))).alias("small")))
    looks = keys.select("id", "n", "s", F.explode(F.array(_partition(F.col("n"), least), _partition(F.col("n"), least) - 1)).alias("part"))
    there = keys.filter("small").select(F.col("id").alias("b"), F.col("n").alias("m"), "s", _partition(F.col("n"), least).alias("part"))
    fits = (F.col("m") >= F.col("n") * F.lit(least) - 1e-9) & ((F.col("m") < F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("b") < F.col("id"))))
    met = looks.join(there, ["part", "s"]).filter(fits).select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")).distinct()
    met = saved(met)
    left = sets.select(F.col("id").alias("a"), F.col("sigs").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("sigs").alias("y"))
    scored = met.join(left, "a").join(right, "b").select("a", "b", likeness(F.col("x"), F.col("y")).alias("similarity"))
    out = saved(scored.filter(F.col("similarity") >= least - 1e-9))
    for df in (counts, keys, met):
        discard(df)
    return out


def similar_documents(documents: DataFrame, least: float = 0.8) -> DataFrame:
    """(doc_id, class_id, copies, links) for every row: the smallest id with an equal fingerprint, how many rows have it,
    and how many other fingerprints are similar at ``least`` or more."""
    rows = documents.select("doc_id", signatures(F.coalesce("text", F.lit(""))).alias("sigs"))
    rows = saved(rows.withColumn("id", F.md5(as_text(F.col("sigs")).cast("binary"))))
    classes = saved(rows.groupBy("id").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"), F.first("sigs").alias("sigs")))
    pairs = similar_pairs(classes, least)
    links = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).groupBy("id").agg(F.count("*").alias("links"))
    told = saved(classes.select("id", "class_id", "copies").join(links, "id", "left").select("id", "class_id", "copies", F.coalesce("links", F.lit(0)).cast("long").alias("links")))
    return rows.select("doc_id", "id").join(told, "id").select("doc_id", "class_id", "copies", "links")


def query(spark, sf_dir: str) -> DataFrame:
    rows = with_next(table(spark, sf_dir, "documents"))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), edited(F.col("text"), F.col("next_text")).alias("edited"), F.col("sigs").alias("own"), F.col("next_sigs").alias("next"))
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "own", "next", signatures(F.col("edited")).alias("other"))
    return rows.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("other")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"))


def similar_query(spark, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"))


_LIST = "[" + ", ".join(f"'{w}'" for w in sorted(set(COMMON_WORDS))) + "]"


def _sql_signatures(text: str) -> str:
    words = f"list_transform(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: CASE WHEN list_contains({_LIST}, w) THEN chr(10) || w ELSE w END)"
    parts = f"string_split(array_to_string({words}, ' ') || ' ', chr(10))"
    chain = "rtrim(array_to_string(string_split(p[i] || coalesce(substr(p[i + 1], instr(p[i + 1], ' ') + 1), ''), ' ')[: 3], ' '), ' ')"
    spots = f"list_transform(range(2, len(p) + 1), lambda i: substr(md5({chain}), 1, 8))"
    whole = "[substr(md5(chr(10) || array_to_string(p, chr(10))), 1, 8)]"
    return f"(SELECT list_sort(list_distinct(CASE WHEN len(p) > 1 THEN {spots} ELSE {whole} END)) FROM (SELECT {parts} AS p))"


_LIKE = "len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b})))::DOUBLE"
ORACLE = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text FROM t WINDOW w AS (ORDER BY doc_id DESC NULLS LAST, text DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT doc_id, text, next_text, length(text) AS n_chars, substr(text, 1, length(text) - length(text) // 3) || substr(next_text, 1, length(text) // 3) AS edited FROM n),
f AS (SELECT doc_id, n_chars, edited, {_sql_signatures("e.text")} AS own, {_sql_signatures("e.next_text")} AS next, {_sql_signatures("e.edited")} AS other FROM e)
SELECT doc_id, n_chars::BIGINT AS n_chars, sha256(edited) AS edited_sha256, array_to_string(own, '') AS fingerprint, array_to_string(other, '') AS edited_fingerprint,
{_LIKE.format(a="own", b="other")} AS near_edited, {_LIKE.format(a="own", b="next")} AS near_next FROM f
"""

SIMILAR_ORACLE = f"""
WITH f AS (SELECT doc_id, {_sql_signatures("coalesce(text, '')")} AS sigs FROM documents),
c AS (SELECT sigs, md5(array_to_string(sigs, '')) AS id, min(doc_id) AS class_id, count(*) AS copies FROM f GROUP BY sigs),
e AS (SELECT id, len(sigs) AS n, unnest(sigs) AS s FROM c),
p AS (SELECT a.id, b.id AS other FROM e a JOIN e b ON a.s = b.s AND a.id <> b.id GROUP BY a.id, b.id, a.n, b.n HAVING count(*)::DOUBLE / (a.n + b.n - count(*)) >= 0.8::DOUBLE - 1e-9),
l AS (SELECT id, count(*) AS links FROM p GROUP BY id)
SELECT f.doc_id, c.class_id, c.copies, coalesce(l.links, 0)::BIGINT AS links FROM f JOIN c ON f.sigs = c.sigs LEFT JOIN l ON l.id = c.id
"""
