"""Line dedup by a deletion-neighbourhood join.

A line is what ``\\n`` separates; its words are runs of other bytes than white space, A-Z lower-cased.
A line is removed if an earlier line (smaller doc_id, then smaller line number) is equal, or, where it
has ``LEAST_WORDS`` words or more, is within one word edit of it: a word replaced, left out or put in.
Lines are judged on the input, not on what is left; lines without words always stay.

Equal lines meet first, by a grouped minimum. A distinct line's neighbourhood is itself and all lines
with one word less, as hashed keys; equal keys join lines within one edit and some within two, and the
place of the deletion verifies which: lines of one length must have it at the same place, and else the
shorter line must be whole. Each key and place keeps its earliest line, so that a group of any size
costs its rows once, never its pairs. A screen that loses nothing comes before it:
lines within one edit have their first or last half in common (of the length floor(n / 2) or
floor((n - 1) / 2)), so only lines that share such a half with another emit their neighbourhoods.

Defined cases: null text has no lines and stays null; an empty text is one line without words; rows
that repeat an id and a text are one document; of rows with one id and several texts, the hash of the
text orders them; a null id comes before all others; an empty table gives an empty result; further
columns, whatever their names, are kept by ``deduplicated`` as they are; a very long text or line is
taken whole (a task holds one text's word hashes, and one line's variants, 12 bytes a word).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, discard, drop_one_hashes, mix64, packed, power_hash, saved, slices, table, unpacked

#: Lines with fewer words are removed only if equal to an earlier one.
LEAST_WORDS = 8
_HALF_SALTS = np.array([0x51ED270B, 0x2545F491, 0x9E3779B1, 0x85EBCA77], dtype=np.uint64)


def _lines(texts: list[bytes]):
    """Of the lines with words: text, line number, first and last word; and all word hashes."""
    words = Words(texts, between=b"\n")
    breaks = np.flatnonzero(words.data == 10)
    line = np.searchsorted(breaks, words.start)
    edge = np.flatnonzero(np.diff(line, prepend=-1))
    lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    at = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
    owner = np.searchsorted(at, words.start[edge], side="right") - 1 if len(edge) else edge
    number = line[edge] - np.searchsorted(breaks, at)[owner] if len(edge) else edge
    return owner, number, edge, np.append(edge[1:], len(line)) if len(edge) else edge, words.hashes(True)


def line_table(documents: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, th, line, n, h, k0..k3): each line with words, its hash and its halves' keys (null if short)."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            ids, th, texts = b.column("doc_id"), b.column("th"), b.column("text").to_pylist()
            for low, high in slices(texts, 2_000_000):
                owner, number, begin, end, words = _lines([t or b"" for t in texts[low:high]])
                n = end - begin
                h = power_hash(words, begin, end)
                keys = []
                for k, half in enumerate((n // 2, n // 2, (n - 1) // 2, (n - 1) // 2)):
                    key = power_hash(words, begin, begin + half) if k % 2 == 0 else power_hash(words, end - half, end)
                    with np.errstate(over="ignore"):
                        key = mix64(key + _HALF_SALTS[k % 2])
                    keys.append(pa.array(key.view(np.int64), mask=(n < least) | ((k > 1) & (n % 2 == 1))))
                at = pa.array(low + owner)
                yield pa.RecordBatch.from_arrays([ids.take(at), th.take(at), pa.array(number.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(h.view(np.int64)), *keys], names=["doc_id", "th", "line", "n", "h", "k0", "k1", "k2", "k3"])

    rows = documents.select("doc_id", F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text")).filter("text is not null")
    return rows.mapInArrow(run, f"doc_id {kind}, th long, line int, n int, h long, k0 long, k1 long, k2 long, k3 long")


def _neighbourhoods(rows: DataFrame) -> DataFrame:
    """(variant, place, rank) of the lines ``lines`` (structs line, h, rank) of each ``text``.

    A variant is the hash of the line without the word at ``place``, or of the whole line (place -1).
    """

    def run(batches):
        for b in batches:
            texts, lines = b.column("text").to_pylist(), b.column("lines").to_pylist()
            for low, high in slices(texts, 1_000_000):
                owner, number, begin, end, words = _lines(texts[low:high])
                spot = {(o, i): k for k, (o, i) in enumerate(zip(owner.tolist(), number.tolist(), strict=True))}
                variants, places, ranks = [], [], []
                for j in range(low, high):
                    for item in lines[j]:
                        k = spot[j - low, item["line"]]
                        less = drop_one_hashes(words, int(begin[k]), int(end[k]))
                        variants += [less.view(np.int64), np.array([item["h"]], np.int64)]
                        places += [np.arange(len(less), dtype=np.int32), np.array([-1], np.int32)]
                        ranks.append(np.full(len(less) + 1, item["rank"], np.int64))
                if ranks:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (variants, places, ranks)], names=["variant", "place", "rank"])

    return rows.select("text", "lines").mapInArrow(run, "variant long, place int, rank long")


def removed_lines(documents: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, th, line): the lines to remove; th is the xxhash64 of the text."""
    position = F.struct("doc_id", "th", "line")
    lines = saved(line_table(documents, least))
    halves = ["k0", "k1", "k2", "k3"]
    distinct = saved(lines.groupBy("h", "n", *halves).agg(F.min(position).alias("at"), F.count("*").alias("c")))

    each = distinct.select("h", F.explode(F.array_distinct(F.array_compact(F.array(*halves)))).alias("half"))
    # what a key table is joined with is written first too: straight from their exchanges, hot keys can be split
    shared = saved(each.groupBy("half").agg(F.count("*").alias("c")).filter("c > 1").select("half"))
    found = each.join(shared, "half", "left_semi").select("h").distinct()
    # ids that grow with the position, so that the least id is the earliest line
    suspects = saved(distinct.join(found, "h", "left_semi").select("h", "at").orderBy("at").withColumn("rank", F.monotonically_increasing_id()))

    asked = suspects.groupBy(F.col("at.doc_id").alias("of"), F.col("at.th").alias("th")).agg(F.collect_list(F.struct("at.line", "h", "rank")).alias("lines"))
    texts = documents.select("doc_id", F.xxhash64("text").alias("tx"), F.col("text").cast("binary").alias("text"))
    joined = texts.dropDuplicates(["doc_id", "tx"]) if _repeats(documents) else texts
    joined = joined.join(asked, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("tx") == F.col("th")))
    around = saved(_neighbourhoods(joined))

    met = saved(around.groupBy("variant").agg(F.min("rank").alias("a"), F.max("rank").alias("b")).filter("a < b").select("variant"))
    close = saved(around.join(met, "variant", "left_semi"))
    discard(around)
    # one length: the same place; lengths that differ by one: the shorter line is whole
    same = saved(close.filter("place >= 0").groupBy("variant", "place").agg(F.min("rank").alias("first")))
    late = close.join(same, ["variant", "place"]).filter("first < rank").select("rank")
    for asks, has in (("place >= 0", "place < 0"), ("place < 0", "place >= 0")):
        first = saved(close.filter(has).groupBy("variant").agg(F.min("rank").alias("first")))
        late = late.union(close.filter(asks).join(first, "variant").filter("first < rank").select("rank"))
    late = suspects.join(late.distinct(), "rank", "left_semi").select("h", F.lit(True).alias("late"))

    known = saved(distinct.select("h", "c", F.col("at").alias("first")).join(late, "h", "left").filter("c > 1 or late"))
    found = lines.select("h", "doc_id", "th", "line").join(known, "h")
    out = saved(found.filter(F.col("late").isNotNull() | (F.col("first") < position)).select("doc_id", "th", "line"))
    for df in (lines, distinct, suspects, close, known):
        discard(df)
    return out


def _repeats(documents: DataFrame) -> bool:
    """Whether a document id occurs more than once."""
    return not documents.groupBy("doc_id").count().filter("count > 1").isEmpty()


def judged(documents: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(row, text, n_lines, n_removed): every row as a struct, its kept lines, and how many it had and lost."""
    gone = removed_lines(documents, least).groupBy(F.col("doc_id").alias("of"), "th").agg(F.collect_set("line").alias("gone"))
    rows = packed(documents, "doc_id", "text").withColumn("tx", F.xxhash64("text"))
    rows = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("tx") == F.col("th")), "left")
    lines = F.split("text", "\n", -1)
    kept = F.filter(F.transform(lines, lambda x, i: F.when(~F.array_contains("gone", i), x)), lambda x: x.isNotNull())
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    n_removed = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long")
    return rows.select("row", text.alias("text"), n_lines.alias("n_lines"), n_removed.alias("n_removed"))


def deduplicated(documents: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """Every row with its kept lines as ``text``; its other columns as they are."""
    return judged(documents, least).select(*unpacked(documents.columns, text=F.col("text")))


def query(spark, sf_dir: str) -> DataFrame:
    df = judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return df.select("row.doc_id", "n_lines", "n_removed", digest.alias("kept_sha256"))


ORACLE = r"""
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, i, s[i] AS raw, doc_id * 1000000 + i AS pos,
  regexp_extract_all(translate(s[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM split)),
kinds AS (SELECT ws, len(ws) AS n, md5(array_to_string(ws, ' ')) AS h, min(pos) AS pos FROM lines WHERE len(ws) > 0 GROUP BY ws),
variants AS (SELECT h, n, pos, p, md5(array_to_string(ws[: p - 1] || ws[p + 1 :], ' ')) AS k FROM (SELECT *, unnest(range(1, n + 1)) AS p FROM kinds WHERE n >= 8)),
late AS (
  SELECT h FROM (SELECT h, pos, min(pos) OVER (PARTITION BY k, n, p) AS first FROM variants) WHERE first < pos
  UNION SELECT v.h FROM variants v JOIN kinds w ON v.k = w.h AND w.n >= 8 AND w.pos < v.pos
  UNION SELECT w.h FROM variants v JOIN kinds w ON v.k = w.h AND w.n >= 8 AND v.pos < w.pos),
marked AS (SELECT l.doc_id, l.i, l.raw, len(l.ws) > 0 AND (l.pos > k.pos OR late.h IS NOT NULL) AS gone
  FROM lines l LEFT JOIN kinds k ON k.ws = l.ws LEFT JOIN late ON late.h = k.h),
per AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, string_agg(raw, chr(10) ORDER BY i) FILTER (NOT coalesce(gone, false)) AS t FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM documents d LEFT JOIN per ON per.doc_id = d.doc_id
"""
