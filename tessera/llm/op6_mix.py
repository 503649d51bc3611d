"""Mixing sources to target weights by capped water-filling.

Sizes are words. Sources in code point order (null last) weigh 5, 2, 1, repeating. The budget is a
share of all words; a source takes at most ``epochs`` times its size, and what it can't take is
shared among the others by weight. Every document is then repeated at its source's rate: whole
repetitions first, then a seeded run of its words for the fraction, rounded up or down by the
document's own draw, so a source's sum is off by rounding only, however few documents it has.

Defined cases: null text has size 0 and is taken 0 times; an empty table gives an empty result;
repeated rows each count; a null id draws as the empty id; a very long text is one row, as its part is;
further columns, whatever their names, are ignored by the plan and kept by ``mixed``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, packed, unpacked

WEIGHTS = (5, 2, 1)
BUDGET, EPOCHS, SEED = 1.5, 2, 17
#: Above so many sources the targets are joined by a shuffle, not broadcast.
MOST_BROADCAST_SOURCES = 50_000


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def draw(doc_id, seed: int):
    """Uniform in [0, 1), from the id alone: a rerun, a retry or another partitioning draws the same."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sizes: DataFrame, budget: float = BUDGET, epochs: int = EPOCHS, weights=WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    With sources in the order of size by weight, the capped ones are a prefix, and the level that the
    others share is the greatest of those that their own cap doesn't stop. One sorted pass over
    per-source sums replaces the loop. The two windows see one row a source, never documents.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(every) - 1, F.lit(len(weights))) + 1).cast("int"))
    df = sizes.withColumn("w", weight).withColumn("cap", F.lit(float(epochs)) * F.col("source_size"))
    order = [(F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(whole)
    level = (F.lit(float(budget)) * total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    df = df.withColumn("level", level).withColumn("capped", F.col("cap") / F.col("w") < F.col("level"))
    df = df.withColumn("shared", F.max(F.when(~F.col("capped"), F.col("level"))).over(whole))
    return df.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("w") * F.col("shared")).alias("target"))


def plan(documents: DataFrame, budget: float = BUDGET, epochs: int = EPOCHS, weights=WEIGHTS, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, source_size, target, taken, *keep) for every row."""
    sized = documents.select("doc_id", "source", word_count(F.col("text")).alias("size"), *keep)
    per = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), budget, epochs, weights)
    if per.count() <= MOST_BROADCAST_SOURCES:
        per = F.broadcast(per)
    per = per.withColumnRenamed("source", "of_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    taken = F.least(F.floor(rate * F.col("size") + draw(F.col("doc_id"), seed)), F.col("size") * F.lit(epochs)).cast("long")
    return sized.join(per, F.col("source").eqNullSafe(F.col("of_source"))).select("doc_id", "size", "source_size", "target", taken.alias("taken"), *keep)


def mixed(documents: DataFrame, **options) -> DataFrame:
    """The mix itself: each document's whole repetitions, then the part of one more, as rows.

    The part is a run of the document's words that starts at a seeded word and goes round its end.
    Columns: those of ``documents``, then ``repetition`` (from 1) and ``words``, named ``mix_repetition``
    or ``mix_words`` where ``documents`` has such a column.
    """
    rows = packed(documents, "doc_id", "source", "text")
    seed = options.get("seed", SEED)
    got = plan(rows, keep=("row",), **options).filter("taken > 0")
    times = F.ceil(F.col("taken") / F.col("size")).cast("int")
    got = got.select("*", F.explode(F.sequence(F.lit(1), times)).alias("repetition"))
    left = F.col("taken") - (F.col("repetition") - 1) * F.col("size")
    got = got.withColumn("words", F.least(left, F.col("size")))
    words = F.regexp_extract_all("row.text", F.lit(WORD_PATTERN), F.lit(0))
    first = F.least(F.floor(draw(F.col("doc_id"), seed + 1) * F.col("size")), F.col("size") - 1).cast("int") + 1
    run = F.array_join(F.slice(F.concat(words, words), first, F.col("words").cast("int")), " ")
    text = F.when(F.col("words") == F.col("size"), F.col("row.text")).otherwise(run)
    own = [F.col(c).alias(c if c not in documents.columns else f"mix_{c}") for c in ("repetition", "words")]
    return got.select(*unpacked(documents.columns, text=text), *own)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return plan(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size
  FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w
  FROM per),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
       - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
      / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
goals AS (
  SELECT source, source_size,
         CASE WHEN cap / w < level THEN cap
              ELSE w * max(CASE WHEN cap / w < level THEN NULL ELSE level END) OVER () END AS target
  FROM levels)
SELECT s.doc_id, s.size, g.source_size, g.target,
       least(floor(CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END * s.size
             + ('0x' || substr(md5('17:' || coalesce(s.doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE)::BIGINT, 2 * s.size) AS taken
FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
"""
